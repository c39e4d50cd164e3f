"""The pipeline against a brute-force version of its stages."""

import re

import numpy as np
import public_tokenizers

import corpus_pipeline
from cubewright.llm.pii import find_pii
from tests.llm.test_llm_small import brute_components, brute_lines, sets_of


def words(rng, n, kinds):
    return " ".join("".join(chr(49 + c) for c in str(int(k) + 10000).encode()) for k in rng.integers(0, kinds, n))


def test_pipeline_matches_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(11)
    shared = "this line is shared by many of the documents here."
    rows = [(i, "\n".join([words(rng, 80, 5000) + ".", shared if i % 2 else "own words only.", words(rng, 40, 5000) + "."])) for i in range(30)]
    rows += [(100 + i, rows[3][1] if i < 2 else rows[5][1].replace("b", "B")) for i in range(4)]
    rows += [(200, "too short"), (201, None), (202, "same word " * 60), (203, words(rng, 90, 5000) + " mail bo.x@mail8.example.com now.")]
    df = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        places = {}
        for j in range(len(w) - 2):
            places.setdefault(tuple(w[j : j + 3]), []).append(j)
        repeats = len({j + d for p in places.values() if len(p) > 1 for j in p for d in range(3)})
        if len(w) >= 50 and 100 * repeats <= 50 * len(w):
            kept.append((i, t))
    lines = brute_lines(kept)
    kept = [(i, lines[i][2]) for i, _ in kept if lines[i][2].strip()]
    label = brute_components(sets_of(kept, 5), 80)
    kept = [(i, t) for i, t in kept if label[i] == i]
    spans = {r["doc_id"]: r["spans"] for r in find_pii(spark.createDataFrame(kept, "doc_id long, text string")).collect()}
    plain, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}
    for i, t in kept:
        for s in sorted(spans[i], key=lambda s: -s["start"]):
            t = t[: s["start"]] + f"<{s['kind']}>" + t[s["end"] :]
        want[i] = len(plain.encode(t, add_special_tokens=False).ids) + 1
    sizes = {}
    for r in got:
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["length"]
    assert sizes == want and len(want) < len(rows) - 5
    assert len({r["sequence_id"] for r in got}) <= -(-sum(want.values()) // 2048) + 1
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_join", "pii", "packing"]


def test_quality_stage_drops_failing_lines(spark):
    good = words(np.random.default_rng(5), 80, 5000) + "."
    rows = [(1, good + "\nAll rights reserved.\n" + good[::-1]), (2, good), (3, "Home | News | About\n" + good), (4, "All rights reserved."), (5, None)]
    df = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.quality_stage(spark, df, "")
    assert tuple(got.columns) == corpus_pipeline.COLUMNS and got.schema == df.schema
    want = {1: good + "\n" + good[::-1], 2: good, 3: good}
    assert {r["doc_id"]: (r["text"], r["n_chars"], r["lang"], r["source"]) for r in got.collect()} == {i: (t, len(t), "en", "src0") for i, t in want.items()}
