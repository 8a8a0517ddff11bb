"""Operators of the pipeline subpackage: SQL, brute force, round trips, and odd inputs."""

import glob
import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pairloom.llm import chat, common, jpeg, language_id, media, mixing, near_dedup, packing, quality, queries, sharding, substring_dedup, topk

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, block int, `row` string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, ids=None):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i if ids is None else ids[i], t, "en", f"s{i % 3}" if i % 5 else None, len(t or ""), 7, "x") for i, t in enumerate(texts)], DOCS)


def odd_texts(seed=0, n=60):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + ["é", "the"]
    passage = " ".join(rng.choice(words) for _ in range(30))
    out = [None, "", " \n", "one", "one two", "the " * 70, "the " * 45 + "end", "a b " * 40, "x" * 3000, passage, "A " + passage.upper()]
    for _ in range(n - len(out)):
        t = [rng.choice(words) for _ in range(rng.randrange(1, 80))]
        if rng.random() < 0.4:
            t[rng.randrange(len(t)) :] = passage.split()[rng.randrange(8) :]
        out.append(" ".join(t))
        if rng.random() < 0.3:
            out.append(out[-1] if rng.random() < 0.5 else out[-1] + " more")
    return out


def rows(df):
    cols = sorted(df.columns)
    return sorted(repr(r) for r in df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_agrees_with_sql(spark, name):
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(c.sql(queries.SQL[name]).df())


# --- 1


def cut_brute(texts, ids, width=20):
    words = [WORD.findall(t or "") for t in texts]
    first = {}
    for i in sorted(range(len(texts)), key=lambda i: ids[i]):
        for s in range(len(words[i]) - width + 1):
            key = tuple(words[i][s : s + width])
            first[key] = min(first.get(key, (ids[i], s)), (ids[i], s))
    out = []
    for i, w in enumerate(words):
        gone = set()
        for s in range(len(w) - width + 1):
            if first[tuple(w[s : s + width])] != (ids[i], s):
                gone.update(range(s, s + width))
        out.append((ids[i], len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_brute_force(spark, seed):
    texts = odd_texts(seed)
    ids = [i if i != 20 else 19 for i in range(len(texts))]  # a doc_id that two rows share
    got = substring_dedup.dedup_substrings(docs(spark, texts, ids)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == cut_brute(texts, ids)


def test_substrings_carry_columns(spark):
    texts = odd_texts(3)
    out = substring_dedup.dedup_substrings(docs(spark, texts), spacing=True, carry=True)
    assert {(r.carried.block, r.carried.row) for r in out.collect()} == {(7, "x")}
    kept = {r.doc_id: r for r in out.collect()}
    assert all(r.kept_text == texts[i] for i, r in kept.items() if not r.n_removed) and kept[0].kept_text is None
    assert substring_dedup.dedup_substrings(docs(spark, [])).count() == 0


# --- 2


def test_shards_fit_or_are_marked(spark):
    texts = ["x" * 10] * 50 + ["y" * 500, None, ""]
    got = sharding.shards(docs(spark, texts, [*range(52), None]), 100).collect()
    size = defaultdict(int)
    for r in got:
        size[r.shard_id] += r.n_bytes
    assert len(got) == 53 and all(r.oversize == (size[r.shard_id] > 100) for r in got)
    assert [r.n_bytes for r in got if r.oversize] == [500]
    same = sharding.shards(docs(spark, ["x" * 60] * 4, [5] * 4), 100).collect()
    assert len({r.shard_id for r in same}) == 1 and all(r.oversize for r in same)
    assert sharding.shards(docs(spark, [])).count() == 0


# --- 3


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = [*odd_texts(4), "été 12'345  \n\n x" * 900, "<|endoftext|> ok", "naïve — “q” 中文 \u00a0 z"]
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in enumerate(texts)}
    got = packing.pack(docs(spark, texts), 64).collect()
    whole, seqs = defaultdict(dict), defaultdict(dict)
    for r in got:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert r.length == len(ids) and r.ids_crc32 == zlib.crc32(bytes(r.ids)) and r.doc_tokens == len(want[r.doc_id])
        whole[r.doc_id][r.start], seqs[r.sequence_id][r.offset] = ids, r.length
    assert {d: [x for s in sorted(p) for x in p[s]] for d, p in whole.items()} == want
    for p in seqs.values():
        assert list(itertools.accumulate([0, *(p[o] for o in sorted(p))]))[:-1] == sorted(p) and sum(p.values()) <= 64
    assert sorted(seqs) == list(range(len(seqs))) and packing.pack(docs(spark, [])).count() == 0


@pytest.mark.parametrize("run", [packing.op3_packing, lambda spark, sf: corpus_pipeline.packing_stage(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)])
def test_packing_of_special_tokens(spark, tmp_path, run):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["<|endoftext|> ok", "a  <|endoftext|><|endoftext|>b", "x \n<|endoftext|>", "<|endoftext|", "it's  fine"]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: [*t.encode(x, add_special_tokens=False).ids, 0] for i, x in enumerate(texts)}
    assert want[0] == [50256, 12876, 0]
    got = {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in run(spark, str(tmp_path)).collect()}
    assert got == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want.items()}


def test_packing_of_long_blank_runs(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = packing.LONG
    runs = [" " * n, "\n" * (n + 1), "\t \u3000\r\n\x85\xa0" * n, "\x1c" * (n + 1), " " * (n - 1)]
    texts = [a + r + b for r in runs for a in ("", "x", "it's!") for b in ("", "y", "'s", "1", "<|endoftext|>z", f"y{r}z")]
    texts += [c * 3_000_000 + b for c in " \n" for b in ("", "end")]
    encode = packing.encoder(specials=True)
    for x in texts:
        assert encode(x) == t.encode(x, add_special_tokens=False).ids
    got = packing.pack(docs(spark, [" " * 3_000_000 + "end", "ok"]), ids=False).groupBy("doc_id").agg(F.sum("length"), F.max("doc_tokens")).collect()
    want = [len(t.encode(x, add_special_tokens=False).ids) + 1 for x in (" " * 3_000_000 + "end", "ok")]
    assert sorted(map(tuple, got)) == [(i, n, n) for i, n in enumerate(want)]


def test_fullest_subset_is_best():
    rng = random.Random(5)
    for _ in range(60):
        counts = np.zeros(33, np.int64)
        for _ in range(rng.randrange(0, 7)):
            counts[rng.randrange(1, 33)] += rng.randrange(1, 3)
        items, room = [n for n, k in enumerate(counts) for _ in range(k)], rng.randrange(0, 33)
        used = packing._fullest(counts, room)
        assert all(counts[n] >= k for n, k in used.items())
        assert sum(n * k for n, k in used.items()) == max(s for r in range(len(items) + 1) for s in map(sum, itertools.combinations(items, r)) if s <= room)


# --- 4


def test_media_round_trip(spark):
    texts = [None, "", "a" * 64, "b" * 65, "é" * 5000, *odd_texts(6, 30)]
    column = common.materialize(media.stored(docs(spark, texts)))  # a media column, and one of tensors read from it
    got = {r.doc_id: r for r in common.materialize(media.read_back(column)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and len(r.rgb) == r.height * r.width * 3
        sums = np.frombuffer(r.rgb, np.uint8).reshape(-1, 3).sum(axis=0, dtype=np.int64)
        assert r.feature == f"{r.width}x{r.height}:" + ",".join(map(str, sums))
    assert got[0].feature == got[1].feature and got[0].media_sha256 == got[1].media_sha256
    assert media.read_back(media.stored(docs(spark, []))).count() == 0


def test_jpeg_code_by_code(monkeypatch):
    payload = np.random.default_rng(0).integers(0, 256, 64 * 13, dtype=np.uint8).tobytes()
    quick = jpeg.decode(jpeg.encode(payload, b""))
    more = jpeg._segment(0xDB, bytes([0]) + bytes([1] * 64)) + jpeg._table(0x00, {1: 1, 2: 1}, bytes([9, 0])) + jpeg._table(0x10, {1: 1, 2: 1}, bytes([8, 0])) + jpeg._table(0x11, {4: 15}, bytes(r << 4 for r in range(15)))
    monkeypatch.setattr(jpeg, "_TABLES", more)  # the same codes in tables of two, so scans are read code by code
    slow = jpeg.decode(jpeg.encode(payload, b""))
    assert all((a["coefs"] == b["coefs"]).all() for a, b in zip(quick["parts"], slow["parts"], strict=True))
    assert (jpeg.pixels(slow)[:16, :16] == media._rgb(jpeg.blocks_of(slow))[0]).all()


def test_inverse_transform_of_a_flat_block():
    c = np.zeros((1, 64))
    c[0, 0] = 80
    assert (jpeg.samples(c) == 138).all() and list(jpeg.ZIGZAG[:6]) == [0, 1, 8, 16, 9, 2]


# --- 5


def kneser_ney(texts, order=quality.ORDER):
    """Interpolated modified Kneser-Ney over bytes, written out with dictionaries."""
    counts = {order: Counter()}
    for t in texts:
        raw = b"\x01" * (order - 1) + t.encode()
        counts[order].update(raw[i : i + order] for i in range(len(raw) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    ds = {}
    for k, c in counts.items():
        n = [sum(v == j for v in c.values()) for j in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if all(n) else 0
        ds[k] = [min(max(j - (j + 1) * y * n[j] / n[j - 1], quality.LEAST), j) for j in (1, 2, 3)] if all(n) else [0.5, 1.0, 1.5]

    def p(g):
        k = len(g)
        if not k:
            return 1 / 256
        own = [(x, v) for x, v in counts[k].items() if x[:-1] == g[:-1]]
        if not own:
            return p(g[1:])
        total, d = sum(v for _, v in own), lambda v: ds[k][min(v, 3) - 1]
        seen = counts[k].get(g, 0)
        return ((seen - d(seen)) / total if seen else 0) + sum(d(v) for _, v in own) / total * p(g[1:])

    return p


def test_perplexity_brute_force(spark):
    texts = ["abab cab", "the cat", None, "", "the dog é", "zzz", "the cat sat on the mat " * 3]
    d = docs(spark, texts)
    good = spark.createDataFrame([(i,) for i in range(len(texts))], "doc_id long")
    held = {r.doc_id for r in good.filter(quality._held()).collect()}
    p = kneser_ney([t for i, t in enumerate(texts) if t is not None and i not in held])
    for r in quality.perplexities(d, good).collect():
        raw = b"\x01" * 4 + (texts[r.doc_id] or "").encode()
        n = len(raw) - 4
        if not n:
            assert r.perplexity is None
        else:
            assert r.perplexity == pytest.approx(math.exp(-sum(math.log(p(raw[i : i + 5])) for i in range(n)) / n), rel=1e-5)


def test_quality_sends_each_gram_once_in_few_bytes():
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"])
    block = table.append_column("lang", pa.nulls(len(table), pa.string())).add_column(0, "block", pa.array([0] * len(table), pa.int32())).combine_chunks()
    sent, ids = pa.Table.from_batches(common._block_parts(block.to_batches())), table.column("doc_id").to_pylist()[::3]
    out = quality._ask(50)(sent, pa.table({"doc_id": pa.array(ids, pa.int64())}))
    grams, counted, trusted = set(), Counter(), set(ids)
    for i, t in zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), strict=True):
        raw = b"\x01" * (quality.ORDER - 1) + (t or "").encode()
        found = [raw[j : j + quality.ORDER] for j in range(len(raw) - quality.ORDER + 1)]
        grams.update(found)
        counted.update(found if i in trusted else ())
    told = [int(k) for x in out.column("keys").to_pylist() for k in quality._keys(x)]
    assert len(told) == len(grams) and set(told) == {int.from_bytes(g, "big") for g in grams}
    merged = quality._merged(out)
    n = dict(zip(merged.column("key").to_pylist(), merged.column("n").to_pylist(), strict=True))
    assert n == {int.from_bytes(g, "big"): counted[g] for g in grams}
    assert sum(len(x or b"") for c in ("keys", "counts") for x in out.column(c).to_pylist()) < 3.5 * len(grams)


def test_quality_on_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long")
    assert {r.kept for r in quality.classify(docs(spark, odd_texts(8, 20)), none).collect()} == {True}
    assert quality.classify(docs(spark, []), none).count() == 0
    out = quality.op5_quality_classifier(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    kept = {(r.quality, r.toxic): r.k for r in out.groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert kept[1, 0] > 0.97 and kept[0, 0] < 0.5


def test_quality_of_unseen_labels(spark):
    """Thresholds from half of the labels, rates on the other half."""
    labels, d = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("labels", "documents"))
    seen, unseen = (labels.filter(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(2)) == k) for k in (0, 1))
    out = quality.classify(d, quality.trusted_labels(seen), quality.bad_labels(seen)).join(unseen, "doc_id")
    kept = {(r.quality, r.toxic): round(r.k, 3) for r in out.groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert kept[1, 0] > 0.93 and kept[0, 0] < 0.05 and kept[0, 1] < 0.05 and kept[1, 1] < 0.6


# --- 6


@pytest.mark.parametrize("text", ["<|end|>\n", "\\<|", "[INST] \\[/INST] <s></s>", "a<", "|>\n<|user|>\n", "\\", None, ""])
def test_escapes_are_exact(spark, text):
    m = spark.createDataFrame([(1, None, "t", "us|>\ner<|", text, 0.0), (2, 1, "t", "assistant", text, 0.0)], "id long, parent long, tree string, role string, text string, score double")
    r = chat.formatted(m).select("text", "loss_mask", chat.turns_of(F.col("text")).alias("turns")).first()
    assert [tuple(x) for x in r.turns] == [("us|>\ner<|", text or ""), ("assistant", text or "")]
    (s, e), = r.loss_mask
    assert spark.createDataFrame([(r.text[s:e],)], "x string").select(chat.unescape(F.col("x"))).first()[0] == (text or "")
    assert r.text.count("<|end|>") == 2 and "[INST]" not in r.text and "</s>" not in r.text


def test_trees(spark):
    #  1 - 2 - 4 - 5, 1 - 3; 6 alone; 7 has no parent there; 8 and 9 are a cycle
    parent = {1: None, 2: 1, 3: 1, 4: 2, 5: 4, 6: None, 7: 99, 8: 9, 9: 8}
    m = spark.createDataFrame([(i, p, 0 if i < 6 else i, "user", str(i), float(i == 3) * 9) for i, p in parent.items()], "id long, parent long, tree long, role string, text string, score double")
    got = {(r.tree, r.leaf, r.rank): [t.text for t in r.turns] for r in chat.formatted(m, 2).withColumn("turns", chat.turns_of(F.col("text"))).collect()}
    assert got == {(0, 3, 1): ["1", "3"], (0, 5, 2): ["1", "2", "4", "5"], (6, 6, 1): ["6"]}
    assert chat.formatted(m.limit(0)).count() == 0


# --- 7


def groups_brute(texts, width, num, den):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(lower))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    top = list(range(len(texts)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            top[max(a, b)] = min(a, b)
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("width", "num", "den"), [(3, 85, 100), (5, 80, 100)])
def test_near_groups_brute_force(spark, monkeypatch, width, num, den):
    rng = random.Random(9)
    base = [f"w{rng.randrange(300)}" for _ in range(120)]
    texts = odd_texts(9)
    for _ in range(60):  # near and less near copies of one text, and of copies of it
        t = list(base)
        for _ in range(rng.randrange(1, 8)):
            t[rng.randrange(len(t))] = "other"
        texts.append(" ".join(t))
    monkeypatch.setattr(near_dedup, "SMALL", 4)  # so that tiles are used as well
    monkeypatch.setattr(near_dedup, "TILE", 2000)
    got = near_dedup.near_groups(docs(spark, texts), width, num, den).collect()
    assert sorted(map(tuple, got)) == groups_brute(texts, width, num, den)


def test_near_groups_odd_tables(spark):
    assert near_dedup.near_groups(docs(spark, []), 3, 85, 100).count() == 0
    got = near_dedup.near_groups(docs(spark, [None, "a b c d"] * 2, [4, 4, 7, 2]), 3, 85, 100).collect()
    assert sorted(map(tuple, got)) == [(2, 2, 2), (4, 0, 4), (4, 2, 2), (7, 0, 7)]


# --- 8


def search_brute(rows, k=5):
    x = [(i, np.floor(256 * np.array(e, float))) for i, e in rows if i is not None and e and all(y is not None and math.isfinite(y) for y in e)]
    out = []
    for a, (q, v) in enumerate(x):
        if q % 50 == 0:
            best = sorted((-int(v @ w), i) for b, (i, w) in enumerate(x) if b != a and len(w) == len(v))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 0.01])
def test_search_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "PIVOTS", 5)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    monkeypatch.setattr(topk, "CHUNK", 4)
    monkeypatch.setattr(topk, "STEP", 8)
    rng = np.random.default_rng(1)
    v = [(i, (scale * rng.integers(-3, 4, 4)).tolist()) for i in range(170)]
    v += [(7, v[9][1]), (7, v[9][1]), (50, v[50][1]), (50, [9.0 * scale] * 4), (0, v[3][1])] + [(300 + i, v[50][1]) for i in range(60)]
    v += [(100, None), (101, [1.0, None, 0.0, 0.0]), (150, [float("nan")] * 4), (103, [float("inf")] * 4), (200, [1.0, 2.0]), (204, [3.0, -1.0]), (105, []), (None, v[0][1])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    got = topk.search(df, F.col("vec_id") % 50 == 0)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == search_brute(v)
    assert topk.search(df.limit(0), F.lit(True)).count() == 0 and topk.search(df.limit(1), F.lit(True)).count() == 0


def test_search_discards_rows(spark):
    """Where vectors have few dimensions, most rows are never scored."""
    rng = np.random.default_rng(2)
    v = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(4000, 3)) / 4)]
    got = topk.search(spark.createDataFrame(v, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == search_brute(v)
    assert sum(r.evaluated for r in got if r["rank"] == 1) < 0.4 * 80 * 4000


def test_search_agrees_with_sql_on_repeats(spark, tmp_path):
    rng = np.random.default_rng(3)
    v = [(int(i), x.tolist()) for i, x in zip(rng.integers(0, 120, 200), rng.integers(-2, 3, (200, 3)).astype(float), strict=True)]
    v += [(7, [7.0, 0.0, 0.0]), (7, [6.5, 0.0, 0.0]), (100, None), (50, [1.0, None, 0.0])]
    spark.createDataFrame(v, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert rows(topk.op8_topk_search(spark, str(tmp_path)).toPandas()) == rows(c.sql(topk.SQL["op8_topk_search"]).df())


# --- 9


def weights_brute(tokens, repeats=mixing.REPEATS, entropy=None):
    full = {k: v for k, v in tokens.items() if v}
    whole = sum(full.values())

    def at(a):
        raw = {k: (v / whole) ** a for k, v in full.items()}
        return {k: v / sum(raw.values()) for k, v in raw.items()}

    def meets(w):
        if entropy is not None:
            return -sum(v * math.log(v) for v in w.values()) <= entropy
        used = [w[k] / full[k] for k in full]
        return max(used) <= repeats * min(used) * (1 + 1e-12)

    lo, hi = 0.0, 1.0
    if not full or meets(at(0.0)):
        return at(0.0) if full else {}
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if meets(at(mid)) else (mid, hi)
    return at(hi)


def totals(spark, tokens):
    return spark.createDataFrame(list(tokens.items()), "source string, tokens long")


@pytest.mark.parametrize("how", [{"repeats": 2.0}, {"repeats": 1.0}, {"entropy": 1.0}, {"entropy": 0.2}, {"entropy": 5.0}])
def test_weights_meet_their_target(spark, how):
    tokens = {"a": 1000, "b": 100, "c": 10, None: 1, "none": 0}
    a, w = mixing.weights(totals(spark, tokens), **how)
    got, want = {r.source: r.weight for r in w.collect()}, weights_brute(tokens, **how)
    assert all(got[k] == pytest.approx(want.get(k, 0.0), rel=1e-9) for k in tokens) and 0 <= a <= 1
    if how == {"entropy": 1.0}:
        assert -sum(x * math.log(x) for x in got.values() if x) == pytest.approx(1.0)
    assert mixing.weights(totals(spark, tokens).limit(0))[1].count() == 0


def mix_brute(rows, how):
    """How often each row is there. rows: (source, tokens, key); rows of one source and key share their fate."""
    by = defaultdict(list)
    for i, (s, n, key) in enumerate(rows):
        by[s].append((key, n, i))
    tokens = {s: sum(n for _, n, _ in own) for s, own in by.items()}
    w = weights_brute(tokens, how.get("repeats", mixing.REPEATS), how.get("entropy"))
    budget = how.get("budget") or max((tokens[s] / w[s] for s in w), default=0)
    times = Counter()
    for s, own in by.items():
        passes, rest = divmod(math.floor(budget * w[s] + 1e-6), tokens[s]) if tokens[s] else (1, 0)
        bits = min(max(math.ceil(math.log2(max(tokens[s], 1) / mixing.BLOCK_TOKENS)), 0), 32)
        blocks = defaultdict(list)
        for key, n, i in own:
            blocks[math.floor(((key % 2**64) >> 1) / 2.0**63 * 2.0**bits)].append((key, n, i))
            times[i] += passes
        start = 0
        for b in sorted(blocks):
            end, size = start, sum(n for _, n, _ in blocks[b])
            for _, same in itertools.groupby(sorted(blocks[b]), lambda x: x[0]):
                same = list(same)
                end += sum(n for _, n, _ in same)
                for _, _, i in same:
                    times[i] += start + size <= rest or (start < rest and end <= rest)
            start += size
    return times


@pytest.mark.parametrize("how", [{"repeats": 1.6}, {"entropy": 0.9}, {"repeats": 1.6, "budget": 2500.0}, {"repeats": 1.0, "budget": 9000.0}])
def test_mix_brute_force(spark, monkeypatch, how):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 50)
    texts = odd_texts(11, 120)
    d = docs(spark, texts)
    key = {r.doc_id: r.key for r in d.select("doc_id", mixing._key().alias("key")).collect()}
    got = mixing.mix(d, **how).collect()
    want = mix_brute([(f"s{i % 3}" if i % 5 else None, len(WORD.findall(t or "")), key[i]) for i, t in enumerate(texts)], how)
    assert Counter(r.row.doc_id for r in got) == +want
    assert all(0 <= r.place <= 1 and r.key == key[r.row.doc_id] for r in got) and {(r.row.block, r.row.row) for r in got} == {(7, "x")}
    first = [r for r in got if r.copy == 0]
    assert all([r.key for r in sorted(own, key=lambda r: (r.block, r.key >= 0, r.key))] == [r.key for r in sorted(own, key=lambda r: r.key % 2**64)] for own in ([r for r in first if r.row.source == s] for s in ("s0", "s1", None)))


def test_mix_odd_tables(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    same = mixing.mix(docs(spark, ["a b"] * 4 + [None] * 2, [1] * 4 + [None] * 2)).collect()
    assert Counter((r.row.doc_id, r.row.source) for r in same) == Counter({(1, "s1"): 1, (1, "s2"): 1, (1, "s0"): 1, (1, None): 1, (None, "s1"): 1, (None, None): 1}) or len(same) >= 6


# --- 10


def test_languages(spark):
    out = language_id.op10_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    odd = docs(spark, [None, "", "12 34 !", "the house"])
    got = language_id.identify(odd, odd.limit(0)).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    got = {r.doc_id: r for r in language_id.identify(odd, docs(spark, ["the house is"])).collect()}
    assert got[3].lang_pred == "en" and got[2].lang_pred == "und" and 0 <= got[3].score <= 1


def features_brute(text):
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    x = [0.0] * language_id.SIZE
    for i in range(len(raw)):
        for k in range(1, min(3, len(raw) - i) + 1):
            key = raw[i]
            for j, by in enumerate((257, 263)[: k - 1], 1):
                key = key * by + raw[i + j]
            x[((key + k) * 2654435761 % 2**32 >> 16) % language_id.SIZE] += 1
    total = sum(x)
    return [math.sqrt(v / total) for v in x] + [1.0]


def vote_brute(x, machines):
    labels, pairs, w = machines
    votes, least = Counter(), {}
    for (i, j), row in zip(pairs, w, strict=True):
        m = sum(a * b for a, b in zip(x, row, strict=True))
        votes[labels[i] if m > 0 else labels[j]] += 1
        for name, sign in ((labels[i], 1), (labels[j], -1)):
            least[name] = min(least.get(name, math.inf), sign * m)
    if not pairs:
        return labels[0]
    most = max(votes.values())
    return max(sorted(n for n in labels if votes[n] == most), key=lambda n: least[n])


def test_languages_brute_force(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    own = d.filter("lang IS NOT NULL").orderBy("doc_id").limit(120).collect()
    model = language_id.train(language_id.features([r.text.encode() for r in own[:60]]).astype(np.float32).astype(float), [r.lang for r in own[:60]])
    texts = [r.text for r in own[60:]] + ["É 12 x", "the", "z", "Straße und Haus"]
    got, _ = language_id.predict(model, texts)
    for t, name in zip(texts, got, strict=True):
        x = features_brute(t)
        assert np.allclose(x, language_id.features([t.encode()])[0])
        assert name == vote_brute(x, model["within"][vote_brute(x, model["families"])])


def test_languages_of_odd_tables(spark):
    texts = [None, "", "12 ?", "the house " * 60_000, "das Haus", "the", "the"]
    d = docs(spark, texts, [0, 1, 2, 3, 4, 5, 5])
    learned = docs(spark, ["the house is red", "a long road"]).unionByName(docs(spark, ["das Haus ist rot", "ein weiter Weg"]).withColumn("lang", F.lit("de")))
    got = language_id.identify(d, learned).collect()
    assert len(got) == 7 and {(r.doc_id, r.lang_pred) for r in got} >= {(0, "und"), (1, "und"), (2, "und"), (3, "en"), (4, "de")}
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 5}) == 1
    assert language_id.identify(docs(spark, []), learned).count() == 0


# --- pipeline


def test_pipeline(spark):
    d = common.table(spark, SF, "documents").withColumn("block", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        out = common.materialize(stage(spark, d, SF))
        assert name == "packing" or out.dtypes == d.dtypes
        d = out
    assert d.agg(F.sum("length")).first()[0] == d.select("doc_id", "start", "doc_tokens").filter("start = 0").agg(F.sum("doc_tokens")).first()[0]
