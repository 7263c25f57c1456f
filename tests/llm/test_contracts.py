"""The queries as they are registered, over a whole small table: columns in their order, and values against plain versions."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import test_operators as plain

from offerlens.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name, columns):
    df = queries.QUERIES[name](spark, SF)
    assert df.columns[: len(columns.split())] == columns.split()
    return df.collect()


def test_op1(spark, texts, monkeypatch):
    monkeypatch.setattr(plain, "DOCS", [(d, t) for d, t in texts.items()])
    got = rows(spark, "op1_near_dedup", "doc_id n_shingles component_id kept")
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == plain.brute_groups(4, 80) and len(got) == len(texts)


def test_op3(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = rows(spark, "op3_packing", "doc_id piece start length ids_crc32 sequence_id offset")
    want, sequences = {}, defaultdict(list)
    for d, text in texts.items():
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            want[d, k] = (at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)]).tolist()]
        assert [at for at, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 4096
    assert len(sequences) <= -(-sum(n for _, n, _ in want.values()) // 4096) + 1


def test_op4(spark, texts):
    got = rows(spark, "op4_suffix_dedup", "doc_id n_bytes n_removed n_spans kept_sha256")
    assert {r.doc_id: tuple(r)[1:5] for r in got} == plain.brute_spans(list(texts.items()), 50) and len(got) == len(texts)


def test_op5(spark, texts):
    got = rows(spark, "op5_lm_scoring", "doc_id held_out n_tokens n_known train_tokens base_score score")
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in texts}
    tokens = {d: [*plain.WORD.findall(plain.lower(t)), None] for d, t in texts.items()}
    seen = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(seen.values()), len(seen)
    assert len(got) == len(texts)
    for r in got:
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(w in seen for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((seen[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) and r.score < 0
    better = [r.score > r.base_score for r in got if r.held_out]
    assert sum(better) > 0.9 * len(better)


def test_op6(spark, texts):
    got = rows(spark, "op6_pii", "doc_id n_email n_ip n_card n_phone base_sha256 spans")
    kinds = ("email", "ip", "card", "phone")
    assert len(got) == len(texts)
    for r in got:
        want = plain.contract_spans(texts[r.doc_id] or "")
        joined = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[1] == k for x in want) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_op8(spark):
    got = rows(spark, "op8_ann", "query_id rank vec_id score")
    table = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    ids = np.array(sorted(table))
    x = np.array([table[k] for k in ids])
    hits = 0
    by_query = defaultdict(list)
    for r in got:
        by_query[r.query_id].append(r)
        assert r.score == pytest.approx(float(table[r.query_id] @ table[r.vec_id]), rel=1e-12) and r.vec_id != r.query_id
    assert set(by_query) == {int(k) for k in ids if k % 20 == 0}
    for q, found in by_query.items():
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, 21)) and [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        s = x @ table[q]
        s[ids == q] = -np.inf
        hits += len({r.vec_id for r in found} & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
    assert hits >= 0.9 * 20 * len(by_query)
