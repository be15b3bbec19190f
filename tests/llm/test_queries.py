"""Every registered query on the smallest tables: its SQL where there is some, otherwise the contract by plain Python."""

import hashlib
import os
import zlib
from collections import Counter, defaultdict

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    from quire.llm.queries import QUERIES

    return QUERIES[name](spark, SF)


def words(text):
    return (text or "").encode().split()


@pytest.mark.parametrize("name", ["op4_chat_formatting", "op9_quality_rules", "op10_url_filters", "op11_merkle_manifest", "op13_conversation_repair"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    from quire.llm.oracles import ORACLES

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = run(spark, name)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.select(*columns).collect()))) == sorted(map(str, want))


def test_fingerprints(spark, documents):
    found = {r["doc_id"]: r for r in run(spark, "op1_fingerprints").collect()}
    ids = sorted(documents)
    for at, i in enumerate(ids):
        text, after = documents[i]["text"] or "", documents[ids[(at + 1) % len(ids)]]["text"] or ""
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert found[i]["n_chars"] == len(text) and found[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= found[i]["near_next"] <= 1 and 0 <= found[i]["near_edited"] <= 1
    long = [r for i, r in found.items() if len(words(documents[i]["text"])) >= 24]
    assert all(r["near_edited"] > 0 for r in long) and sum(r["near_edited"] for r in long) > 20 * sum(r["near_next"] for r in long)
    by_text = defaultdict(set)
    for i, r in found.items():
        by_text[documents[i]["text"]].add(r["fingerprint"])
    assert max(map(len, by_text.values())) == 1


def test_simhash(spark, documents):
    found = {r["doc_id"]: r for r in run(spark, "op2_simhash_near_dedup").collect()}
    ids, root = sorted(found), {i: i for i in found}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (int(found[a]["fingerprint"], 16) ^ int(found[b]["fingerprint"], 16)).bit_count() <= 3:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    assert set(found) == set(documents) and all(found[i]["component_id"] == top(i) for i in ids)


def test_secrets(spark, documents):
    from llm_plain import plain_secrets

    for r in run(spark, "op3_secret_scans").collect():
        spans = plain_secrets(documents[r["doc_id"]]["text"] or "")
        kinds = Counter(k for k, _, _ in spans)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_mixing(spark, documents):
    found = run(spark, "op5_source_mixing").collect()
    got, target, size = Counter(), {}, Counter()
    for r in found:
        doc = documents[r["doc_id"]]
        assert r["size"] == len(words(doc["text"])) and r["taken"] in (0, r["size"], 2 * r["size"])
        got[doc["source"]] += r["taken"]
        size[doc["source"]] += r["size"]
        target[doc["source"]] = r["target"]
    assert len(found) == len(documents) and all(abs(got[s] - target[s]) <= max(10, 0.02 * target[s]) for s in target)
    assert sum(target.values()) == pytest.approx(min(1.5, 2) * sum(size.values()), rel=1e-6) and all(target[s] <= 2 * size[s] + 1e-6 for s in target)


def test_toxicity(spark, documents):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    found = run(spark, "op6_toxicity").collect()
    assert {r["doc_id"] for r in found} == set(documents)
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    known = [(r["predicted"], labels[r["doc_id"]]) for r in found if r["doc_id"] in labels]
    assert sum(p == t for p, t in known) >= 0.85 * len(known)


def test_sharding(spark, documents):
    found = run(spark, "op7_sharding").collect()
    shards = defaultdict(list)
    for r in found:
        raw = (documents[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 8, zlib.crc32(raw), "rows")
        shards[r["shard"]].append(r["slot"])
    assert set(shards) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1


def test_packing(spark, documents):
    from tokenizers import Tokenizer

    from quire.llm import packing

    plain = Tokenizer.from_file(packing.vocabulary_path())
    found = run(spark, "op8_best_fit_packing").collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, doc in documents.items():
        ids, at = [*plain.encode(doc["text"] or "", add_special_tokens=False).ids, 2], 0
        for n, r in enumerate(sorted(pieces[i], key=lambda r: r["piece"])):
            raw = b"".join(x.to_bytes(4, "little") for x in ids[at : at + r["length"]])
            assert (r["piece"], r["start"], r["ids_crc32"]) == (n, at, zlib.crc32(raw)) and (r["length"] == 1024 or n == 0)
            at += r["length"]
        assert at == len(ids)
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= 1.01 * -(-sum(r["length"] for r in found) // 1024) + 1


def test_contract_columns(spark):
    from quire.llm.queries import QUERIES

    want = {
        "op1": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op2": "doc_id fingerprint component_id", "op3": "doc_id n_assign n_access n_hex base_sha256 spans",
        "op5": "doc_id size source_size target taken", "op7": "doc_id size text_crc32 law shard slot grown_shard", "op10": "page_id host path rule verdict",
    }
    for name, f in QUERIES.items():
        if columns := want.get(name.split("_")[0]):
            assert set(columns.split()) <= set(f(spark, SF).columns), name
