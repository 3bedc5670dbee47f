"""The pipeline stage by stage against plain Python, on planted documents with nulls, repeats, copies and extra columns."""

import random
import re
import zlib
from collections import Counter
from hashlib import md5

import numpy as np
import pytest

import corpus_pipeline
from wordloom.llm.packing import cut_lengths
from wordloom.llm.tokens import vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, stay_id long"
W = re.compile(r"[^\x20\x09-\x0D]+")
SECRETS = re.compile(r"""(?:password|token)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}|AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}""")


def planted():
    rng = random.Random(4)
    good, bad = [f"alpha{k} beta{k % 7}" for k in range(60)], [f"zz{k} ### $$$" for k in range(50)]
    text = lambda words, n=60: " ".join(rng.choices(words, k=n))
    texts = [text(good if k % 4 else bad) for k in range(120)]
    texts[7] += " token = abcdef123456 and more"
    texts[9] = "AKIA" + "B" * 16 + " " + texts[9] + " " + "0123456789abcdef" * 2
    near = texts[1].split(" ")
    near[60] = "changed"
    texts += [texts[5], texts[5], " ".join(near), texts[2] + " end", None, "", " \n"]
    rows = [(k, t, "en", ("a", "b", "b", None)[k % 4 if k % 3 else 0], len(t or ""), k, 5) for k, t in enumerate(texts)]
    return [*rows, rows[6], (None, text(good), "de", "a", 3, None, None), (None, text(good), "de", "c", 3, None, None)]


def values(df):
    return Counter(tuple(r) for r in df.collect())


def near_copies(rows, n=5, percent=80):
    sets = [frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if (w := W.findall((r[1] or "").lower())) else frozenset() for r in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                label = [label[b] if x == label[a] else x for x in label]
    return label, sets


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    to = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(planted(), SCHEMA).repartition(3).write.parquet(f"{to}/documents.parquet")
    spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{to}/labels.parquet")
    return str(to)


def test_stages_equal_plain_python(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    outputs = {}
    for name, function in corpus_pipeline.STAGES:
        before, columns = docs.collect(), docs.columns
        docs = corpus_pipeline.stage(function(spark, docs, folder), f"test-{name}")
        if name != "packing":
            assert docs.columns == columns
        outputs[name] = (before, docs.collect())

    before, kept = outputs["quality_classifier"]
    assert Counter(map(tuple, kept)) == Counter(tuple(r) for r in before if r["text"] and r["text"].strip() and "###" not in r["text"])

    before, kept = outputs["jaccard_join"]
    label, sets = near_copies(before)
    groups = Counter(label)
    of = {tuple(r): x for r, x in zip(before, label)}
    assert Counter(of[tuple(r)] for r in kept) == Counter(dict.fromkeys(groups, 1))
    for r in kept:  # the smallest id of its group
        ids = [x["doc_id"] for x, g in zip(before, label) if g == of[tuple(r)]]
        assert r["doc_id"] == min((i for i in ids if i is not None), default=None)

    before, after = outputs["secret_scan"]
    want = [(*tuple(r)[:1], t := SECRETS.sub("[SECRET]", r["text"]), *tuple(r)[2:4], r["n_chars"] if t == r["text"] else len(t), *tuple(r)[5:]) for r in before]
    assert Counter(map(tuple, after)) == Counter(want) and any("[SECRET]" in r["text"] for r in after)

    before, mixed = outputs["source_mixing"]
    size = {tuple(r): len(W.findall(r["text"])) for r in before}
    order = sorted({r["source"] for r in before}, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    copies = []
    for s in order:
        queue = sorted((r for r in before if r["source"] == s), key=lambda r: (md5((r["text"] if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest(), size[tuple(r)]))
        at = 0
        for turn in range(2):
            for r in queue:
                at += size[tuple(r)]
                copies.append((at / weight[s], s is None, s or "", turn, tuple(r)))
    budget, taken = int(1.5 * sum(size.values())), Counter()
    for *_, r in sorted(copies, key=lambda c: c[:4]):
        taken[r] += min(size[r], budget)
        budget -= min(size[r], budget)
    assert Counter(map(tuple, mixed)) == Counter({r: n for r in taken if (n := int(taken[r] / size[r] + 0.5))})

    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(vocabulary_path()).encode
    before, pieces = outputs["packing"]
    want = Counter()
    for r in before:
        ids, at = [*encode(r["text"] or "", add_special_tokens=False).ids, 1], 0
        for n in cut_lengths(np.array([len(ids)]), 2048)[0].tolist():
            want[(r["doc_id"], at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()), len(ids))] += 1
            at += n
    assert Counter(tuple(r)[:5] for r in pieces) == want
    assert sorted(r["sequence_id"] for r in pieces) == list(range(len(pieces)))

    whole = corpus_pipeline.run(spark, folder)
    assert Counter(tuple(r)[:5] for r in whole.collect()) == want


def test_empty_documents(spark, folder, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and "sequence_id" in out.columns
