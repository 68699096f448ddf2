"""Fixed values that results depend on."""

# Source priorities and base confidences.
SOURCE_PRIORITY = {"recruiter.csv": 2.0, "ats.json": 1.5, "github_api": 1.0}
# Resume section headers.
SECTION_HEADERS = ("skills", "technical skills", "experience", "work experience", "projects", "education", "achievements", "certifications", "publications", "summary", "objective", "contact")
SOURCE_CONFIDENCE = {"recruiter.csv": 1.0, "ats.json": 0.95, "github_api": 0.7, "github_api_repo_language_skill": 0.5, "resume_pdf": 0.6, "resume_docx": 0.6, "resume_skill_section": 0.4}
DISAGREEMENT_PENALTY = 0.9
FUZZY_SKILL_PENALTY = 0.95
BAD_EMAIL_FACTOR = 0.4
REVIEW_THRESHOLD = 0.5

# Skill spellings and their canonical names.
SKILLS = {
    "js": "JavaScript", "javascript": "JavaScript", "reactjs": "React", "react.js": "React", "react": "React", "ts": "TypeScript", "typescript": "TypeScript", "golang": "Go", "go": "Go",
    "py": "Python", "python": "Python", "c++": "C++", "cpp": "C++", "c#": "C#", "csharp": "C#", "html5": "HTML", "html": "HTML", "css3": "CSS", "css": "CSS", "node": "Node.js", "nodejs": "Node.js",
    "node.js": "Node.js", "aws": "AWS", "amazon web services": "AWS", "k8s": "Kubernetes", "kubernetes": "Kubernetes", "java": "Java", "ruby": "Ruby", "php": "PHP",
}
# Country spellings that differ from the official names.
COUNTRIES = {
    "usa": "US", "united states": "US", "united states of america": "US", "us": "US", "uk": "GB", "united kingdom": "GB", "great britain": "GB", "uae": "AE", "united arab emirates": "AE",
}
# Attribute values too common to say anything.
STOPLIST = ("student", "self-employed", "unemployed", "freelance", "n/a", "none")

# Resume patterns.
RESUME_EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
RESUME_PHONE = r"(?:\+?\d{1,3}[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}"
