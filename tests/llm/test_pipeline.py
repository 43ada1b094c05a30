"""The pipeline's stages take effect one after the other and keep clean documents."""

import hashlib
import importlib.util
import random
import re
from pathlib import Path

import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from cadenza.llm import bpe, decontaminate, queries

_spec = importlib.util.spec_from_file_location("text_operators", Path(__file__).with_name("test_text_operators.py"))
brute = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(brute)


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    vocab = [f"word{chr(97 + k % 26)}{k}" for k in range(900)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = say(30)
    rows = [(d, "\n".join(say(12) for _ in range(6))) for d in range(40)]
    shared = "\n".join(f"header line {k}" for k in range(9))
    rows += [(50, rows[3][1].replace("worda", "wordb", 1)), (51, say(20) + " " + passage + " " + say(20)), (52, "12 34 !!"), (53, None)]
    rows += [(60 + k, shared + "\n" + "\n".join(say(10) for _ in range(4))) for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("bigint").alias("n_chars"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, passage)], "item_id BIGINT, text STRING").write.parquet(str(tmp_path / "benchmark.parquet"))
    seen, now = {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == df.columns, name
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r["doc_id"]: r["text"] for r in now.collect()}
    first, second, third, fourth = seen.values()
    assert 52 not in first and 53 not in first and len(first) == len(rows) - 2
    assert sum("header line 5" in t for t in second.values()) < 4 and second[60] == dict(rows)[60]
    assert 50 not in third and set(range(40)) <= set(third)
    assert 51 not in fourth and set(range(40)) <= set(fourth)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == set(fourth)


def near_groups(rows):
    """doc_id -> least doc_id of its group, from all pairs of shingle sets."""
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def test_the_chain_equals_brute_force(spark, tmp_path):
    rng = random.Random(7)
    vocab = [f"w{chr(97 + k % 26)}{k}" for k in range(400)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, say(n)) for k, n in enumerate((14, 25, 40, 6))]
    block = [say(9) for _ in range(8)]
    rows = []
    for d in range(70):
        lines = [say(rng.randint(3, 14)) for _ in range(rng.randint(1, 12))]
        if d % 5 == 0:
            lines[len(lines) // 2 : 0] = block
        if d % 7 == 0:
            lines.append(say(4) + " " + items[d % 4][1] + " " + say(4))
        rows.append((d, "\n".join(lines)))
    for k in range(20):  # near copies, some hardly near
        words = rows[rng.randrange(70)][1].split(" ")
        for _ in range(max(1, len(words) // rng.choice((20, 40, 80)))):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((100 + k, " ".join(words)))
    rows += [(200, rows[4][1]), (201, ""), (202, None), (203, "!! 12 34"), (204, "\n".join(block)), (205, "é\n\n\nè")]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("bigint").alias("n_chars"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id BIGINT, text STRING").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = [(d, t) for d, t in rows if t and any(c.isalpha() for c in t)]  # one language is learned: all with a letter
    left = brute.removed_lines(kept)
    kept = [(d, left[d]) for d, t in kept if left[d] != "" or t == left[d]]
    least = near_groups(kept)
    kept = [(d, t) for d, t in kept if least[d] == d]
    leaked = brute.brute_contamination(kept, items, decontaminate.RUN)
    data, pattern = queries.vocabulary()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.parse_ranks(data), special_tokens={})
    want = {}
    for d, t in kept:
        if d not in leaked:
            ids = enc.encode_ordinary(t)
            want[d] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want and leaked and len(left) < len(rows) and any(d != x for d, x in least.items())


def test_an_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "some words")], "item_id BIGINT, text STRING").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
