from corpus_pipeline import PERCENT, SHINGLE, STAGES
from tests.llm.test_jaccard_join import brute, near_copies

near_duplicates = dict(STAGES)["near_duplicates"]
SCHEMA = "doc_id long, text string, lang string, key string, rest string, _key long"


def test_near_duplicates_against_brute_force(spark):
    """Repeated rows, columns with the names used inside, texts without words and null ids."""
    texts = near_copies(7)
    rows = [(i, t, "en", f"k{i}", f"r{i}", i) for i, t in enumerate(texts)]
    worded = {i for i, t in enumerate(texts) if t and t.split()}
    first = {i for i, (_, c) in brute(texts, SHINGLE, PERCENT).items() if c == i or i not in worded}
    more = [(0, texts[0], "en", "a", "r0", 0), (0, texts[0], "en", "k0", "r0", 0), (None, None, "en", "none", "none", -1)]
    out = near_duplicates(spark, spark.createDataFrame(rows + more, SCHEMA), "")
    assert out.columns == ["doc_id", "text", "lang", "key", "rest", "_key"]
    expected = [r for r in rows if r[0] in first and r[0] != 0] + [more[0], more[2]]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, expected))


def test_no_documents(spark):
    assert near_duplicates(spark, spark.createDataFrame([], SCHEMA), "").count() == 0
