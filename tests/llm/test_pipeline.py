"""The pipeline, each stage against brute force over the very rows it gets, and on odd tables."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ops import WORD, cut_brute, docs, groups_brute, kneser_ney, mix_brute, odd_texts

import corpus_pipeline
from pairloom.llm import common, mixing, quality

CLASHING = ("kept", "component_id", "n_words", "n_removed", "key", "place", "weight", "perplexity", "part", "nth", "carried", "trusted", "n_bytes", "bucket", "payload")


def table(spark, texts, ids=None):
    """Documents with columns whose names the stages use themselves."""
    d = docs(spark, texts, ids)
    return d.select("*", *(F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHING))


def texts_of(seed):
    out = odd_texts(seed, 50)
    passage = " ".join(f"p{k}" for k in range(60))
    near = "near " + " ".join(f"q{k % 37}z{k}" for k in range(90))
    return [*out, f"one {passage} x y", f"two words {passage} z", near, near + " more", near.upper(), "x\x0by\tz", "<|endoftext|> end", " " * 12_000 + "end"]


def labels_of(spark, n, folder):
    rows = [(i, int(i % 4 != 1), int(i % 11 == 3)) for i in range(n) if i % 7]
    spark.createDataFrame([*rows, (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def kept_brute(spark, rows, labels):
    """Places of the rows that the classifier keeps."""
    good, bad = {i for i, q, t in labels if q == 1 and not t}, {i for i, q, t in labels if q == 0 or t == 1}
    ids = sorted({r.doc_id for r in rows if r.doc_id is not None})
    held = {r.doc_id for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").filter(quality._held()).collect()}
    p = kneser_ney([r.text for r in rows if r.text and r.doc_id in good - held])
    ppl = []
    for r in rows:
        raw = b"\x01" * (quality.ORDER - 1) + (r.text or "").encode()
        n = len(raw) - quality.ORDER + 1
        ppl.append(math.exp(-sum(math.log(p(raw[i : i + quality.ORDER])) for i in range(n)) / n) if n else None)
    known = [(x, r.doc_id, r.lang) for x, r in zip(ppl, rows, strict=True) if x is not None]
    cut = lambda v, q: sorted(v)[max(math.ceil(q * len(v)), 1) - 1] if v else None

    def bounds(lang, lo, hi):
        lows = [x for x, i, lg in known if i in good and lg == lang] or [x for x, i, _ in known if i in good]
        highs = [x for x, i, lg in known if i in good & held and lg == lang] or [x for x, i, _ in known if i in good & held]
        return cut(lows, lo), cut(highs, hi)

    def fine(x, lang, lo, hi):
        a, b = bounds(lang, lo, hi)
        return (a is None or x >= a * (1 - 1e-6)) and (b is None or x <= b * (1 + 1e-6))

    clean, no, all_ = [k for k in known if k[1] in good & held], [k for k in known if k[1] in bad], [k for k in known if k[1] in good]
    best, chosen = -math.inf, (quality.UPPER, quality.LOWER)
    if clean and no:
        for hi in quality.UPPERS:
            for lo in quality.LOWERS:
                right = len(all_) * sum(fine(x, lg, lo, hi) for x, _, lg in clean) / len(clean) - sum(fine(x, lg, lo, hi) for x, _, lg in no)
                if right > best + 1e-9:
                    best, chosen = right, (hi, lo)
    hi, lo = chosen
    return [x is None or not good or fine(x, r.lang, lo, hi) for x, r in zip(ppl, rows, strict=True)]


def by_row(rows, columns=None):
    return Counter(repr([r[c] for c in (columns or sorted(r.asDict()))]) for r in rows)


@pytest.mark.parametrize("seed", [2])
def test_whole_pipeline_brute_force(spark, tmp_path, monkeypatch, seed):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 50)
    texts = texts_of(seed)
    ids = [i if i != 20 else 19 for i in range(len(texts))]
    d = table(spark, texts, ids).unionByName(table(spark, texts[30:33], [None, 31, 32]))
    labels = labels_of(spark, len(texts), str(tmp_path))
    stages, sf = dict(corpus_pipeline.STAGES), str(tmp_path)
    assert list(stages) == ["quality", "near_dedup", "substring_dedup", "mixing", "packing"]

    rows = d.collect()
    out = common.materialize(stages["quality"](spark, d, sf))
    assert out.dtypes == d.dtypes
    keeps = kept_brute(spark, rows, labels)
    stay = {r.doc_id for r, k in zip(rows, keeps, strict=True) if k}  # rows of one doc_id stay or go together
    assert by_row(out.collect()) == by_row([r for r in rows if r.doc_id in stay])

    d, rows = out, out.collect()
    out = common.materialize(stages["near_dedup"](spark, d, sf))
    assert out.dtypes == d.dtypes
    n_null = [r for r in rows if r.doc_id is None]
    some = [r for r in rows if r.doc_id is not None]
    order = sorted(range(len(some)), key=lambda i: some[i].doc_id)
    groups = groups_brute([some[i].text for i in order], 5, 80, 100)
    kept = {some[order[i]].doc_id for i, _, top in groups if some[order[i]].doc_id == some[order[top]].doc_id}
    assert by_row(r for r in out.collect() if r.doc_id is not None) == by_row(r for r in some if r.doc_id in kept) and len(n_null) <= 1

    d, rows = out, out.collect()
    out = common.materialize(stages["substring_dedup"](spark, d, sf))
    assert out.dtypes == d.dtypes
    rest = [c for c in d.columns if c not in ("text", "n_chars")]
    assert by_row(out.collect(), rest) == by_row(rows, rest)
    want = cut_brute([r.text for r in rows], [-1 if r.doc_id is None else r.doc_id for r in rows])
    got = [(-1 if r.doc_id is None else r.doc_id, " ".join(WORD.findall(r.text or ""))) for r in out.collect()]
    assert Counter(got) == Counter((i, t) for i, _, _, t in want)
    same = {(r.doc_id, r.text) for r in rows}
    assert all((r.doc_id, r.text) in same or r.n_chars == len(r.text) for r in out.collect())

    d, rows = out, out.collect()
    out = common.materialize(stages["mixing"](spark, d, sf))
    assert out.dtypes == d.dtypes
    keys = [r.k for r in d.select(mixing._key().alias("k")).collect()]
    times = mix_brute([(r.source, len(WORD.findall(r.text or "")), k) for r, k in zip(rows, keys, strict=True)], {})
    assert by_row(out.collect()) == by_row([r for i, r in enumerate(rows) for _ in range(times[i])])

    d, rows = out, out.collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in stages["packing"](spark, d, sf).collect():
        pieces[r.doc_id].append((r.start, r.length, r.doc_tokens, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for r in rows:
        x = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want[r.doc_id] += [(lo, min(1024, len(x) - lo), len(x), __import__("zlib").crc32(x[lo : lo + 1024].tobytes())) for lo in range(0, len(x), 1024)]
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024


@pytest.mark.parametrize("name", list(dict(corpus_pipeline.STAGES)))
def test_stages_of_odd_tables(spark, tmp_path, name):
    labels_of(spark, 10, str(tmp_path))
    stage = dict(corpus_pipeline.STAGES)[name]
    empty = stage(spark, table(spark, []), str(tmp_path))
    assert empty.count() == 0 and (name == "packing" or empty.columns == table(spark, []).columns)
    blank = table(spark, [None, "", " \n", None], [1, 1, None, None])
    out = stage(spark, blank, str(tmp_path)).collect()
    assert len(out) >= (2 if name == "near_dedup" else 4) and (name == "packing" or {r.doc_id for r in out} <= {1, None})
    long = stage(spark, table(spark, ["word " * 200_000, "word " * 200_000, "other words here"], [5, 6, 7]), str(tmp_path)).collect()
    assert {r.doc_id for r in long} >= {5, 7}
