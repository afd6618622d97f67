"""The pipeline's stages on a small table, against what each should keep."""

import re
import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


def test_pipeline(spark, tmp_path):
    import random

    import corpus_pipeline

    r = random.Random(12)
    syl = {"en": ["th", "ing", "er", "on"], "fr": ["eau", "ère", "que", "oi"]}
    make = lambda k, n: " ".join("".join(r.choice(syl[k]) for _ in range(r.randint(1, 4))) for _ in range(n))
    base = [(i, make(k, r.randint(20, 90)), k, f"s{i % 3}") for i in range(150) for k in [r.choice(["en", "fr"])]]
    copies = [(1000 + i, *base[i][1:]) for i in range(10)]
    near = [(2000 + i, base[i + 20][1] + " extra", *base[i + 20][2:]) for i in range(10)]
    junk = [(3000, "1 2 3 4", None, "s0"), (3001, None, None, "s0"), (3002, "", None, None)]
    df = spark.createDataFrame([(a, b, c, d, len(b or "")) for a, b, c, d in base + copies + near + junk], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "bpe":
            assert out.columns == df.columns
            out.write.parquet(str(tmp_path / name))
            out = spark.read.parquet(str(tmp_path / name))
        seen[name], docs = out.collect(), out
    ids = {k: {x["doc_id"] for x in v} for k, v in seen.items()}
    assert ids["language_id"] == {x[0] for x in base + copies + near}
    assert ids["exact_dedup"] == ids["language_id"] - set(range(10))
    words = {x["doc_id"]: re.findall(r"\S+", x["text"]) for x in seen["exact_dedup"]}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in words.items()}
    gone = {b for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert gone and ids["ngram_join"] == ids["exact_dedup"] - gone
    sizes = {i: len(w) for i, w in words.items()}
    source = {x["doc_id"]: x["source"] for x in seen["ngram_join"]}
    taken, whole = Counter(), Counter()
    for x in seen["mixing"]:
        taken[x["source"]] += sizes[x["doc_id"]]
    for i, s in source.items():
        whole[s] += sizes[i]
    assert max(Counter(x["doc_id"] for x in seen["mixing"]).values()) <= 2
    assert abs(sum(taken.values()) - 1.5 * sum(whole.values())) < 30
    assert len(seen["bpe"]) == len(seen["mixing"]) and all(x["n_tokens"] > 0 for x in seen["bpe"])


def test_pipeline_odd_tables(spark, tmp_path, odd, none):
    """Empty tables, repeated rows, shared and null ids, clashing columns: every stage keeps the columns it got."""
    import corpus_pipeline

    for name, table in (("odd", odd), ("none", none), ("again", odd.unionByName(odd))):
        docs = table.drop("kept", "size", "row_key") if name == "again" else table
        for k, (stage, f) in enumerate(corpus_pipeline.STAGES):
            out = f(spark, docs, str(tmp_path))
            if stage != "bpe":
                assert out.columns == docs.columns, (name, stage)
            path = str(tmp_path / f"{name}{k}")
            out.write.parquet(path)
            docs = spark.read.parquet(path)
            if stage == "ngram_join" and name != "none":
                assert len({r["text"].lower() for r in docs.collect()}) == docs.count() - sum(r["doc_id"] is None for r in docs.collect())
        assert (docs.count() == 0) == (name == "none")


def test_registered_queries(spark, tmp_path):
    """The thin queries over small tables, chats with conversation -1 among them."""
    import hashlib

    from deucebase.llm import queries

    chats = [(7, 1, "assistant", "b"), (7, 0, "user", "a"), (8, 0, "user", None), (None, 0, "user", "x")]
    spark.createDataFrame(chats, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in queries.op7_chat_format(spark, str(tmp_path)).collect()}
    said = "</s>[INST] ok [/INST]"
    assert set(got) == {-1, 7, 8, None}
    assert (got[-1]["n_turns"], got[-1]["loss_chars"], got[-1]["loss_sha256"]) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())
    assert got[-1]["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert (got[7]["loss_chars"], got[7]["turns_sha256"]) == (1, hashlib.sha256(b"user\na\nassistant\nb\n").hexdigest()) and got[8]["loss_chars"] == 0
