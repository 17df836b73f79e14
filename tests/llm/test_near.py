import corpus_pipeline
import numpy as np

from treeweft.llm.near import keep_first_near
from treeweft.llm.simhash import keep_first


def plain_sets(text):
    words = (text or "").lower().split()
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_kept(rows):
    sets = [plain_sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                root[top(i)] = top(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), name), name)
    return {name for i, (name, _) in enumerate(rows) if least[top(i)] == name}


def test_stage_finds_similarity_of_four_fifths(spark):
    """Copies with changes spread over the text, chains of them, a large group, and pairs on both sides of 0.8."""
    rng = np.random.default_rng(3)
    texts = [None, " ", "a b", "A  b", "a c"]
    for _ in range(25):
        base = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(40, 300))]
        texts.append(" ".join(base))
        for _ in range(6):
            base = list(base)
            for at in rng.integers(0, len(base), max(1, len(base) * int(rng.integers(1, 5)) // 120)):
                base[at] = f"x{rng.integers(0, 5000)}"
            texts.append(" ".join(base))
    base = [f"g{x}" for x in rng.integers(0, 5000, 100)]
    for i in range(40):
        base[i] = "new"
        texts.append(" ".join(base))
    same = [f"s{x}" for x in range(104)]  # 100 runs: 90 and 10 others are below 0.9, and 89 of 111 are just over 0.8
    for lost in (11, 12):
        same_but = [*same[lost:], *(f"t{lost}-{x}" for x in range(lost))]
        texts += [" ".join(f"{lost}{w}" for w in same), " ".join(f"{lost}{w}" if w[0] == "s" else w for w in same_but)]
    rows = [(int(n), t) for n, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, frame, "").collect()}
    want = plain_kept(rows)
    assert kept == want and 30 < len(want) < len(rows) / 2


def test_rows_without_ids_and_without_rows(spark):
    text = "one two three four five six seven"
    frame = spark.createDataFrame([(None, text), (3, text), (3, "third")], "doc_id long, text string")
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.near_duplicates(spark, frame, "").collect())
    assert kept == [(3, text), (3, "third")]
    assert corpus_pipeline.near_duplicates(spark, frame.limit(0), "").count() == 0


def test_columns_that_clash(spark):
    text = "one two three four five six seven"
    rows = [(1, text, 5, "a", None, 7), (2, text, 6, "b", None, 8), (3, "other", 7, "c", None, 9)]
    kind = "doc_id long, text string, _gone long, key string, n binary, _id long"
    frame = spark.createDataFrame(rows, kind)
    kept = corpus_pipeline.near_duplicates(spark, frame, "")
    assert kept.columns == frame.columns and sorted(kept.collect()) == [rows[0], rows[2]]
    frame = frame.withColumnsRenamed({"key": "_first", "n": "component_id"})
    assert sorted(keep_first(frame).collect()) == [rows[0], rows[2]]
    assert sorted(keep_first_near(frame).collect()) == [rows[0], rows[2]]
