"""Each operator against brute force, and on nulls, empties, ties, repeats and clashing names."""

import functools
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import chat, graph, mixing, packing, quality, secrets, sharding, simhash, toxicity, urls, winnowing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "row long, size long, hash long, doc string, copies long, failed_rule string, fp long, k_source string"
random.seed(7)
WORDS = ["alpha", "Beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "größe", "naïve", "日本", "x"]


def sentence(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


@functools.cache
def texts():
    base = sentence(120)
    near = base.replace("alpha", "alpha", 1) + " tail"
    return [base, base, near, "", None, "one", "two words", " \t\n ", sentence(60) + "\n" + sentence(60), "a" * 3000, sentence(4000), base, "By " * 200, "\n".join(["same line here"] * 40)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", ["s1", "s0", None, "s2"][i % 4], len(t or "")) for i, t in enumerate(texts())]
    rows.append(rows[0])  # a repeated row
    rows.append((None, "a row without an id " * 20, "en", "s1", 400))
    return spark.createDataFrame(rows, DOCS).repartition(3)


def clashing(df):
    return df.select("*", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in CLASHING.split(", ")])


def empty(spark):
    return spark.createDataFrame([], DOCS)


def keyed(df, *cols):
    return [(r["doc_id"], *[r[c] for c in cols]) for r in df.collect()]


# 1 fingerprints


def winnowed(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").lower()) if w]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    if not words:
        return []
    if len(words) < 3:
        grams = [xxhash.xxh64_intdigest(" ".join(words).encode(), 42)]
    else:
        hashes, full = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words], (1 << 64) - 1
        turn = lambda v, by: ((v << by) | (v >> (64 - by))) & full if by else v
        grams = []
        for i in range(len(words) - 2):
            v = 0
            for j in range(3):
                v ^= turn(hashes[i + j], 2 - j)
            grams.append(v)
    grams, kept = [signed(g) for g in grams], []
    for i in range(max(1, len(grams) - 3)):
        window = grams[i : i + 4]
        p = i + max(k for k, v in enumerate(window) if v == min(window))
        if not kept or kept[-1][0] != p:
            kept.append((p, grams[p]))
    return kept


def test_fingerprints_equal_brute_force(docs):
    own = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = {r["doc_id"]: r for r in winnowing.fingerprint_documents(clashing(own)).collect()}
    known = [(i, t or "") for i, t in enumerate(texts())]
    for i, text in known:
        following = known[(i + 1) % len(known)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = got[i]
        assert list(zip(r["fp"]["positions"], r["fp"]["hashes"], strict=True)) == winnowed(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = ({h for _, h in winnowed(t)} for t in (text, edited, following))
        alike = lambda x, y: 1.0 if not x | y else len(x & y) / len(x | y)
        assert r["near_edited"] == pytest.approx(alike(a, b))
        assert r["near_next"] == pytest.approx(alike(a, c))


def test_fingerprints_of_odd_tables(spark, docs):
    assert winnowing.fingerprint_documents(docs).count() == docs.count()
    assert winnowing.fingerprint_documents(empty(spark)).count() == 0
    one = winnowing.fingerprint_documents(spark.createDataFrame([(5, "a b c d e f g", "en", "s", 13)], DOCS)).first()
    assert one["near_next"] == 1.0


def test_shared_passage_is_found(spark):
    passage = sentence(winnowing.WINDOW + winnowing.GRAM - 1)
    a, b = ({h for _, h in winnowed(f"{sentence(30)} q{i} {passage} z{i} {sentence(30)}")} for i in range(2))
    assert a & b


# 2 near-duplicates


def brute_components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(docs):
    own = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = {r["doc_id"]: r for r in simhash.near_duplicates(clashing(own)).collect()}
    fps = [plain_fingerprint(t) for t in texts()]
    for i, c in enumerate(brute_components(fps)):
        assert got[i]["fp"] & (2**64 - 1) == fps[i]
        assert got[i]["component_id"] == c


def test_hamming_links_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    seeds = rng.integers(-(2**63), 2**63, 40, dtype=np.int64)
    found = set(seeds.tolist())
    for s in seeds[:20].tolist():
        for _ in range(12):
            v = s
            for b in rng.integers(0, 64, rng.integers(1, 5)).tolist():
                v ^= (1 << b) if b < 63 else -(1 << 63)
            found.add(v)
    values = sorted(found)
    want = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    got = {(r["a"], r["b"]) for r in simhash.hamming_links(spark.createDataFrame([(v,) for v in values], "fp long")).collect()}
    assert got == want


def test_dedup_keeps_one_of_each(spark, docs):
    kept = simhash.drop_near_duplicates(clashing(docs))
    assert kept.columns == clashing(docs).columns
    ids = [r["doc_id"] for r in kept.collect()]
    want = {i for i, c in enumerate(brute_components([plain_fingerprint(t) for t in texts()])) if i == c}
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 1
    assert simhash.drop_near_duplicates(empty(spark)).count() == 0


def test_dedup_decides_by_row(spark):
    a, b, c = "red green blue " * 20, " ".join(f"m{i}" for i in range(40)), " ".join(f"n{i}" for i in range(40))
    fps = [plain_fingerprint(t) for t in (a, b, c)]
    assert len(set(brute_components(fps))) == 3
    # id 2 has a copy of id 1's text and a text of its own; ids 5 and 6 hold copies of another
    rows = [(1, a), (2, a), (2, b), (5, c), (6, c), (7, None), (7, b)]
    kept = simhash.drop_near_duplicates(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS))
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == sorted([(1, a), (2, b), (5, c), (7, "")])
    # two unlinked texts of one id are both left, in groups that their id must not join
    kept = simhash.drop_near_duplicates(spark.createDataFrame([(1, a, "en", "s", 0), (1, b, "en", "s", 0), (1, b, "en", "s", 0)], DOCS))
    assert sorted(r["text"] for r in kept.collect()) == sorted([a, b])


def test_rows_without_an_id_link_others(spark, monkeypatch):
    # the text stands for its fingerprint: 0 and 63 differ in six bits, and only a row without an id lies between
    monkeypatch.setattr(simhash, "fingerprints", lambda c: c.cast("long"))
    own = spark.createDataFrame([(3, "63"), (None, "7"), (4, "0"), (None, str(1 << 40))], "doc_id long, text string")
    got = {(r["fp"], r["component_id"]) for r in simhash.near_duplicates(own).collect()}
    assert got == {(63, 3), (7, 3), (0, 3), (1 << 40, 3)}
    far = spark.createDataFrame([(3, "63"), (None, "-1")], "doc_id long, text string")
    assert {(r["fp"], r["component_id"]) for r in simhash.near_duplicates(far).collect()} == {(63, 3), (-1, None)}


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(1, 200)] + [(500, 501), (7, 7)]
    got = dict(graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 1 for i in range(1, 201)) and got[501] == 500
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hubs_are_joined_by_broadcast(spark, monkeypatch):
    from quire.llm import skew

    monkeypatch.setattr(skew, "HOT_ROWS", 5)
    monkeypatch.setattr(skew, "HOT_SHARE", 10)
    edges = [(0, i) for i in range(1, 120)] + [(i, i + 1000) for i in range(1, 60)] + [(5000, 5001)]
    got = dict(graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(v == (5000 if k >= 5000 else 0) for k, v in got.items()) and len(got) == 120 + 59 + 2


# 3 secrets


def plain_secrets(text):
    out = [("assign", *m.span()) for m in secrets.ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_secrets_equal_plain_scanning():
    parts = ["password", "Token", "secret", "=", ":", " ", '"', "AKIA", "ABCDEFGH12345678", "deadbeef", "0123abcdef", "é", "K", "\n", "api_key", "passwd", "toKEN=", "日"]
    for _ in range(4000):
        text = "".join(random.choice(parts) for _ in range(random.randint(1, 14)))
        assert [s for s in secrets.find_secrets(text) if s[0] in secrets.BASE_KINDS] == plain_secrets(text)


def test_checksums_decide():
    body = "Ab3" * 10
    good, bad = f"ghp_{body}{secrets.token_checksum(body)}", f"ghp_{body}000000"
    assert secrets.find_secrets(f"é {good}.") == [("platform_token", 2, 42)]
    assert secrets.find_secrets(bad) == []
    import base64

    der = base64.b64encode(b"\x30\x05\x02\x03abc").decode()
    key = f"-----BEGIN RSA PRIVATE KEY-----\n{der}\n-----END RSA PRIVATE KEY-----"
    assert secrets.find_secrets(key)[0] == ("private_key", 0, len(key))
    assert secrets.find_secrets(key.replace(der, base64.b64encode(b"\x30\x05\x02\x04abc").decode())) == []


def test_more_embedded_checks():
    import base64

    raw = bytes.fromhex("0488ADE4") + bytes(range(74))
    raw += hashlib.sha256(hashlib.sha256(raw).digest()).digest()[:4]
    n, key = int.from_bytes(raw, "big"), ""
    while n:
        n, d = divmod(n, 58)
        key = secrets.BASE58[d] + key
    assert secrets.find_secrets(f"k {key}.") == [("wallet_key", 2, 2 + len(key))]
    assert secrets.find_secrets(f"k {key[:-1]}{'2' if key[-1] != '2' else '3'}.") == []
    for kind, prefix, upper in (("age_key", "age-secret-key-", True), ("nostr_key", "nsec", False)):
        data = [random.randrange(32) for _ in range(52)]
        state = secrets.bech32_state(prefix, [*data, *[0] * 6]) ^ 1
        text = prefix + "1" + "".join(secrets.BECH32[d] for d in [*data, *[state >> 5 * (5 - i) & 31 for i in range(6)]])
        text = text.upper() if upper else text
        assert secrets.find_secrets(text) == [(kind, 0, len(text))]
        assert secrets.find_secrets(text[:-1] + ("Q" if upper else "q") * (text[-1] not in "Qq") + ("P" if upper else "p") * (text[-1] in "Qq")) == []
    field = lambda b: len(b).to_bytes(4, "big") + b
    for checks, found in ((b"abcdabcd", 1), (b"abcdabce", 0)):
        body = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + b"\0\0\0\1" + field(b"public") + field(checks + b"rest")
        pem = f"-----BEGIN OPENSSH PRIVATE KEY-----\n{base64.b64encode(body).decode()}\n-----END OPENSSH PRIVATE KEY-----"
        assert sum(k == "private_key" for k, _, _ in secrets.find_secrets(pem)) == found


def test_secrets_of_tables(spark, docs):
    rows = spark.createDataFrame([(1, "x password=hunter22 y", None, None, None), (2, None, None, None, None)], DOCS)
    out = {r["doc_id"]: r for r in secrets.redact_secrets(clashing(rows)).collect()}
    assert out[1]["text"] == "x [SECRET] y" and out[1]["n_chars"] == 12 and out[2]["text"] is None and out[2]["n_chars"] == 0
    assert secrets.scan_secrets(docs).count() == docs.count()
    assert secrets.scan_secrets(empty(spark)).count() == 0


# 4 chat


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a <|im_end|> & &lt; b"), (1, 1, "assistant", "<|im_start|>assistant\nok"), (1, None, None, None), (2, 0, "ro\nle<", ""), (None, 3, "assistant", "x"), (1, 1, "assistant", "<|im_start|>assistant\nok")]
    rows += [(3, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(600)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("chunk", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat.digest(chat.format_chat(turns)).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append(((-1 if t is None else t), role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns_of in by.items():
        turns_of.sort()
        loss = "".join(t for _, role, t in turns_of if role == "assistant")
        assert got[c]["n_turns"] == len(turns_of)
        assert got[c]["turns_sha256"] == sha("".join(f"{role}\n{t}\n" for _, role, t in turns_of))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), sha(loss))
    assert chat.format_chat(turns.limit(0)).count() == 0


def test_chunks_are_bounded(spark):
    rows = [(1, None, "assistant", f"t{i:04}") for i in range(1000)] + [(1, 3, "user", "same")] * 700
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chunks = chat.format_chat(turns)
    most = chunks.select(F.size(chat.read_turns(F.col("formatted"))).alias("n")).agg(F.max("n")).first()[0]
    r = chat.digest(chunks).first()
    assert most == chat.CHUNK and r["n_turns"] == 1700
    assert r["loss_sha256"] == hashlib.sha256("".join(f"t{i:04}" for i in range(1000)).encode()).hexdigest()


def test_typed_parts_become_placeholders(spark):
    part = lambda kind, **v: (kind, v.get("text"), v.get("ref"), v.get("width"), v.get("height"), v.get("seconds"), v.get("pages"))
    content = [part("text", text="see <"), part("image", ref="a.png", width=56, height=29), part("audio", ref="b.wav", seconds=1.5), part("document", ref="c.pdf", pages=2), part("text")]
    turns = spark.createDataFrame([(1, 0, "user", content), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, content array<{chat.PART}>")
    r = chat.format_chat(turns, F.col("content")).first()
    assert "see &lt;<|image|><|audio|><|document|><|im_end|>" in r["formatted"]
    assert [(a["type"], a["ref"], a["tokens"]) for a in r["attachments"]] == [("image", "a.png", 4), ("audio", "b.wav", 38), ("document", "c.pdf", 1024)]
    assert r["expanded_tokens"] == 1066


# 5 mixing


def water_filled(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not full:
            return out | {s: weight[s] * level for s in free}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= full
    return out


def balanced(sizes, target, cap=2):
    """An independent solution of the dual: bisection on the multiplier."""
    sizes = np.array(sizes, dtype=float)
    low, high = -700 / sizes[sizes > 0].min(), np.log(cap) / sizes[sizes > 0].min()
    for _ in range(300):
        mid = (low + high) / 2
        met = (sizes * np.minimum(cap, np.exp(np.minimum(mid * sizes, 1)))).sum()
        low, high = (mid, high) if met < target else (low, mid)
    return np.minimum(cap, np.exp(np.minimum(high * sizes, 1)))


def test_mixing_meets_targets(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng.choice([3, 40, 41, 300])), "en", rng.choice(["a", "b", "c", None, "d", "a", "a"]), 0) for i in range(900)]
    rows += [(1000 + i, "the same text again and again", "en", "a", 0) for i in range(400)]
    frame = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(clashing(frame)).toPandas()
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(t.split())
    want = water_filled(sizes)
    assert len(out) == len(rows) and out.copies.max() <= 2 and out.copies.min() >= 0
    for s, target in want.items():
        own = out[out.source.isna()] if s is None else out[out.source == s]
        assert own.target.iloc[0] == pytest.approx(target)
        assert own.rate.to_numpy() == pytest.approx(balanced(own["size"], target), abs=1e-5)
        assert abs((own.copies * own["size"]).sum() - target) <= 3
        per = own.groupby("size").copies
        assert (per.max() - per.min()).max() <= 1
        wished = own.groupby("size").rate.sum() - per.sum()
        assert abs(wished[own["size"].max()]) <= 0.51  # the largest class owes nothing to others
    again = mixing.mix(frame.repartition(7)).toPandas()
    assert out.sort_values("doc_id").copies.tolist() == again.sort_values("doc_id").copies.tolist()


def test_mixing_of_repeated_rows(spark):
    same = "five words in this text"
    rows = [(7, same, "en", "b", 0)] * 90 + [(None, same, "en", "b", 0)] * 90 + [(i, sentence(30), "en", "a", 0) for i in range(100, 160)]
    frame = spark.createDataFrame(rows, DOCS).repartition(5)
    out = mixing.mix(frame).toPandas()
    taken = (out.copies * out["size"]).groupby(out.source).sum()
    for s, target in water_filled({"a": 1800, "b": 900}).items():
        assert abs(taken[s] - target) <= {"a": 15, "b": 2.5}[s]  # half a document
    assert len(out) == 240 and out[out.source == "b"].copies.nunique() > 1  # the threshold falls among equal rows
    assert mixing.repeat_mixed(frame).groupBy("source").count().collect() != []
    counts = {r[0]: r[1] for r in mixing.repeat_mixed(frame).groupBy("source").count().collect()}
    assert counts == out.groupby("source").copies.sum().to_dict()


def test_many_sources_and_extreme_targets(spark):
    rows = [(i, "w " * (1 + i % 7), "en", f"s{i:04}", 0) for i in range(500)] + [(1000 + i, "w " * 3000, "en", "s0000", 0) for i in range(40)]
    out = mixing.mix(spark.createDataFrame(rows, DOCS)).toPandas()
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(t.split())
    want = water_filled(sizes)
    targets = out.groupby("source").target.first()
    assert all(targets[s] == pytest.approx(t) for s, t in want.items())
    big = out[out.source == "s0000"]
    assert abs((big.copies * big["size"]).sum() - want["s0000"]) <= 3000


def test_mixing_odd_tables(spark, docs):
    out = mixing.mix(docs).toPandas()
    assert len(out) == docs.count() and (out.copies[out["size"] == 0] == 0).all()
    assert mixing.mix(empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, "en", "a", 0), (2, " ", "en", None, 0)], DOCS)
    assert mixing.mix(blank).toPandas().copies.tolist() == [0, 0]
    repeated = mixing.repeat_mixed(clashing(docs))
    assert repeated.columns == clashing(docs).columns and repeated.count() == out.copies.sum()
    assert mixing.repeat_mixed(empty(spark)).count() == 0


# 6 toxicity


def test_toxicity_held_out(spark):
    rng, bad = random.Random(5), ["idiot", "scum", "loser", "zzgrumpf", "zzgrompf"]
    rows, labels = [], []
    for i in range(600):
        words, label = sentence(80).split(), int(rng.random() < 0.3)
        for _ in range(3 * label):
            words.insert(rng.randrange(80), rng.choice(bad))
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, label))
    rows += [(900, None, None, None, None), (901, "", None, None, None), rows[0], (None, "idiot", None, None, None)]
    frame = spark.createDataFrame(rows, DOCS)
    model = toxicity.train(frame, spark.createDataFrame([*labels, labels[0], (3, 1, None)], "doc_id long, quality int, toxic int"))
    out = toxicity.score_toxicity(clashing(frame), model).toPandas()
    truth = {i: y for i, _, y in labels}
    held = out[out.held_out & out.doc_id.notna() & out.doc_id.isin(truth)]
    assert len(out) == len(rows) and out.score.between(0, 1).all()
    assert (held.predicted == held.doc_id.map(truth)).mean() > 0.97
    assert bool(held.held_out.all()) and all(zlib.crc32(str(int(i)).encode()) % 4 == 2 for i in held.doc_id)
    assert out[out.doc_id == 900].predicted.iloc[0] == 0
    nothing = toxicity.train(frame, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert nothing.score(["x", None]).tolist() == [0.0, 0.0]
    assert toxicity.score_toxicity(empty(spark), model).count() == 0


def test_very_long_texts_are_linear():
    import time

    model = toxicity.fit(["idiot you", "a fine day"] * 20, np.array([1, 0] * 20))
    began = time.perf_counter()
    model.score(["a" * 2_000_000, "A1" * 400_000, "ab$" * 300_000, "idiot " * 200_000])
    assert time.perf_counter() - began < 20
    plain = re.compile(r"[^\W\d_]+(?:[0-9@$*!|]+[^\W\d_]+)+")
    for _ in range(3000):
        text = "".join(random.choice("aé1$! _.b*") for _ in range(random.randint(0, 14)))
        assert toxicity._OBFUSCATED.findall(text) == plain.findall(text)


def test_features_equal_plain_counting():
    lexicon = toxicity.Lexicon({"zzgrump": 2.0}, {"zzgr": 1.0, "zzgru": 1.5})
    own = dict(zip(toxicity.NAMES, toxicity.features("You IDIOT, zzgrump! fine st0p sc*um. zzgrx", lexicon), strict=True))
    assert own["seed_rate"] == pytest.approx(100 / 7) and own["seed_kinds"] == 1 and own["word_odds"] == 2.0 and own["word_rate"] == pytest.approx(100 / 7)
    assert own["prefix_rate"] == pytest.approx(200 / 7) and own["prefix_odds"] == 2.5 and own["near_you"] == pytest.approx(200 / 7)
    assert own["capitals"] == pytest.approx(6 / 7) and own["exclaims"] == pytest.approx(1 / 7) and own["stops"] == pytest.approx(2 / 7)
    assert own["obfuscated"] == pytest.approx(2 / 7) and own["obfuscated_seed"] == 1


def test_trees_equal_brute_force():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 6, (300, 3)).astype(float)
    y = (x[:, 1] + (x[:, 0] > 3) + rng.normal(size=300) > 3).astype(int)
    model = toxicity.grow(x, y, trees=1, depth=1, rate=1.0)
    p = y.mean()
    gain = {}
    for j in range(3):
        for cut in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1])):
            left = x[:, j] <= cut
            part = lambda rows: ((p - y[rows]).sum()) ** 2 / (rows.sum() * p * (1 - p) + 2.0)
            gain[j, cut] = part(left) + part(~left)
    best = max(gain, key=lambda k: gain[k])
    assert model.features[0][0] == best[0] and gain[0 + model.features[0][0], model.cuts[0][0]] == pytest.approx(gain[best])
    margin = model.margin(x)
    left = x[:, model.features[0][0]] <= model.cuts[0][0]
    assert margin[left][0] == pytest.approx(model.base - (p - y[left]).sum() / (left.sum() * p * (1 - p) + 2.0))


def test_isotonic_equals_brute_force():
    rng = np.random.default_rng(1)
    s, y = rng.integers(0, 30, 200).astype(float), rng.integers(0, 2, 200)
    x, f = toxicity.isotonic(s, y)
    for at in np.unique(s):  # the largest mean of a stretch ending later, the least over its beginnings
        want = max(min(y[(s >= a) & (s <= b)].mean() for b in np.unique(s) if b >= at) for a in np.unique(s) if a <= at)
        assert np.interp(at, x, f) == pytest.approx(want)


def test_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    s = rng.normal(size=500)
    x, y = toxicity.isotonic(s, (rng.random(500) < 1 / (1 + np.exp(-s))).astype(int))
    assert (np.diff(x) >= 0).all() and (np.diff(y) >= -1e-12).all() and 0 <= y.min() <= y.max() <= 1


# 7 sharding


@pytest.mark.parametrize("n", [1, 2, 3, 24, 25, 1000, 4097])
def test_permutation_is_one_to_one(n):
    p = sharding.permute(np.arange(n), n)
    assert sorted(p.tolist()) == list(range(n))
    assert sharding.permute(p, n, inverse=True).tolist() == list(range(n))


def test_shards(spark, docs):
    out = sharding.assign_shards(clashing(docs), 5).collect()
    n = docs.count()
    assert sorted(r["row"] for r in out) == list(range(n))
    counts = Counter(r["shard"] for r in out)
    assert max(counts.values()) - min(counts.values()) <= 1
    for shard in counts:
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(counts[shard]))
    for r in out:
        assert sharding.place_of(r["row"], n, 5) == (r["shard"], r["slot"])
        assert sharding.row_at(r["shard"], r["slot"], n, 5) == r["row"]
    known = {r["doc_id"]: r for r in out}
    assert known[4]["size"] == 8 and known[4]["text_crc32"] == 0
    assert sharding.assign_shards(empty(spark)).count() == 0


# 8 packing


def test_encoding_equals_the_tokenizer():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.vocabulary_path())
    quick = packing.WordCache(packing.vocabulary_path(), packing.vocabulary_path(packing.RANKS))
    parts = [" ", "\n", "a", "Foo", "'s", "1", "!", "  ", "\t", "é", " ", " ", "<|endoftext|>", "\x1c", "日本", "naïve", "ñ", "€", "½", "\xa0", "\x85", "İ"]
    cases = ["".join(random.choice(parts) for _ in range(random.randint(0, 12))) for _ in range(4000)]
    got = quick.encode(cases)
    for e, g in zip(plain.encode_batch(cases, add_special_tokens=False), got, strict=True):
        assert e.ids == np.frombuffer(g, "<u4").tolist()


def test_packing_places_every_piece(spark, docs):
    out = packing.pack(clashing(docs), packing.vocabulary_path(), capacity=64, with_ids=True, ranks_path=packing.vocabulary_path(packing.RANKS)).collect()
    pieces = Counter((r["doc_id"], r["piece"]) for r in out)
    assert pieces[(0, 0)] == 2 and pieces[(3, 0)] == 1
    for r in out:
        assert r["length"] == len(r["ids"]) <= 64 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        assert r["length"] == 64 or r["piece"] == 0
    by = defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(empty(spark), packing.vocabulary_path()).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plans_are_whole_and_tight(seed):
    rng = np.random.default_rng(seed)
    histogram = {int(k): int(v) for k, v in zip(rng.integers(1, 257, 150), rng.integers(1, 5000, 150), strict=True)}
    runs, n, placed = packing.plan_runs(histogram, 256)
    seen, free = Counter(), defaultdict(lambda: 256)
    for r in runs:
        seen[int(r["length"])] += int(r["n"])
        for s in range(int(r["sequence"]), int(r["sequence"] + r["n"])):
            free[s] -= int(r["length"])
    assert seen == histogram and len(free) == n and min(free.values()) >= 0
    plain = packing.Placement(histogram, 256)
    packing.best_fit_rest(plain)
    assert -(-sum(k * v for k, v in histogram.items()) // 256) <= n <= 1.003 * plain.sequences
    assert placed > 0.6 * sum(histogram.values())  # most pieces come through configurations


def test_packing_keeps_wide_ids_beside_null(spark):
    wide = (1 << 60) + 1
    frame = spark.createDataFrame([(wide, "a b c"), (None, "d"), (wide + 2, None)], "doc_id long, text string").coalesce(1)
    out = packing.pack(frame, packing.vocabulary_path()).collect()
    assert {r["doc_id"] for r in out} == {wide, None, wide + 2}
    pages = frame.selectExpr("doc_id AS page_id", "'http://a.net/es/' AS url")
    assert {r["page_id"] for r in urls.filter_urls(pages).collect()} == {wide, None, wide + 2}


def test_packing_of_a_very_long_text(spark):
    words = 400_000
    frame = spark.createDataFrame([(1, "word " * words), (2, "x")], "doc_id long, text string")
    out = packing.pack(frame, packing.vocabulary_path(), ranks_path=packing.vocabulary_path(packing.RANKS)).toPandas()
    own = out[out.doc_id == 1]
    assert own.length.sum() > words and (own.length[own.piece > 0] == 1024).all() and out.sequence_id.nunique() == len(out) - 1


def test_plan_beats_best_fit_where_it_fails():
    histogram = {501: 6000, 252: 6000, 251: 6000, 248: 12000}
    plain = packing.Placement(histogram, 1000)
    packing.best_fit_rest(plain)
    assert packing.plan_runs(histogram, 1000)[1] == 9000 < plain.sequences == 11000


# 9 quality


def plain_measures(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures_equal_plain_counting(docs):
    names = tuple(quality.measures(F.lit(""), F.array(F.lit(""))))
    measured = docs.select("doc_id", "text", quality.measured(F.col("text"), names).alias("m")).select("doc_id", "text", "m.*")
    for r in measured.collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_measures(r["text"])


def test_cascade_order_changes_no_verdict(spark, docs):
    by = quality.measures(F.col("text"), quality.words_of(F.col("text")))
    judged = docs.select("doc_id", *[quality.cascade(order, by).isNull().alias(n) for n, order in (("a", quality.RULES), ("b", quality.RULES[::-1]))])
    assert all(r["a"] == r["b"] for r in judged.collect())
    kept = quality.drop_rejected(clashing(docs))
    assert kept.columns == clashing(docs).columns
    assert {r["doc_id"] for r in kept.collect()}.isdisjoint({3, 4, 5, 6, 7, 12, 13})
    assert quality.drop_rejected(empty(spark)).count() == 0


def test_sample_is_spread_and_bounded(spark):
    rows = [(i, ("$ " if i >= 3000 else "plain words ") * 60, "en", "s", 0) for i in range(4000)]
    share = {n: r for n, _, r in quality.estimate(spark.createDataFrame(rows, DOCS).coalesce(2))}
    assert 0.1 < share["symbols"] < 0.45  # the quarter at the end of the table is seen
    kept = quality.drop_rejected(spark.createDataFrame([(1, "Short clean text."), (2, " "), (3, None)], "doc_id long, text string"), quality.rules(min_words=1))
    assert [r["doc_id"] for r in kept.collect()] == [1]


def test_rules_are_ordered_by_rejection_per_cost(monkeypatch):
    names = [r.name for r in quality.RULES]
    monkeypatch.setattr(quality, "estimate", lambda docs, rules, rows=0: [(n, 1.0, 0.9 if n == names[3] else 0.1 if n == names[1] else 0.0) for n in names])
    assert [r.name for r in quality.ordered(None)][:2] == [names[3], names[1]]


# 10 URLs


def test_urls(spark):
    cases = {
        None: ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), "": ("", "", None, "allow"),
        "http://Example.COM/en/x": ("example.com", "/en/x", "example.com/en/", "block"),
        "http://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://m.www.example.com/EN/": ("m.www.example.com", "/EN/", "com/", "allow"),
        "http://a.net/es/1?x=/fr/": ("a.net", "/es/1", "net/es/", "block"),
        "http://com": ("com", "", None, "allow"), "http://xnet/es/": ("xnet", "/es/", None, "allow"),
        "https://www.casino-win.org/de#a": ("www.casino-win.org", "/de", None, "block"),
        "https://ads.example.org?x": ("ads.example.org", "", None, "block"),
        "https://a.org/track/click/1": ("a.org", "/track/click/1", None, "block"),
        "https://a.org/casinos": ("a.org", "/casinos", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(cases)], "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(pages).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    assert urls.filter_urls(pages.limit(0)).count() == 0


def test_tokens_are_derived():
    known = {r.name: r.tokens for r in urls.PATTERN_RULES}
    assert known["bet-win"] == ("bet", "win") and known["pills"] == ("pills",) and known["adult-cam"] == ("adult",) and known["tracker-path"] == ("track", "click")
    for regex in ("casino", "^casino", "casino$", r"/x/?y/", r"\bfoo\b", r"(?i)^foo[.]", r"^foo\d*/", "/foo[^/]/", "/foo(-|)x", "/(foo/)?bar", "(?=/)foo/"):
        assert not set(urls.required_tokens(regex)) & {"casino", "x", "y", "foo"}, regex
    assert urls.required_tokens("^casino$") == ("casino",) and urls.required_tokens("^(a|b)/foo(-|$)") == ("foo",) and urls.required_tokens("/(foo/)?bar/") == ("bar",)


def generated_rules(rng):
    words = [f"w{i}" for i in range(300)] + ["com", "net", "www", "k"]
    shapes = (r"(^|[.-])%s[.-]", r"/%s(/|$)", "%s", r"^%s[.]", r"(^|/)(%s|never)/")
    patterns = tuple(urls.PatternRule(f"p{i}", rng.choice(shapes) % rng.choice(words)) for i in range(3000))
    hosts = {(h := urls.HostRule(rng.choice(["allow", "block"]), ".".join(rng.sample(words, rng.randint(1, 2))), rng.choice(["", "/", "/w1"]))).name: h for _ in range(400)}
    links = [None, "", "x", "HTTP://W1.\u212aom/W3"] + ["http://" + ".".join(rng.sample(words, 3)) + "/" + "/".join(rng.sample(words, 2)) + rng.choice(["", "?w1", "#w2"]) for _ in range(250)]
    return tuple(hosts.values()), patterns, links * 2


def test_index_and_table_equal_running_every_rule(spark):
    hosts, patterns, links = generated_rules(random.Random(1))
    pages = spark.createDataFrame([(None if i == 5 else (1 << 60) + i, u) for i, u in enumerate(links)], "page_id long, url string")

    def plain(url):
        host, path = urls.split_url(url)
        best = urls.longest_fit(iter(hosts), host, path)
        if best:
            return host, path, best.name, best.verdict
        return host, path, None, "block" if any(re.search(r.regex, host + urls.ascii_lower(path)) for r in patterns) else "allow"

    want = sorted(((None if i == 5 else (1 << 60) + i, *plain(u)) for i, u in enumerate(links)), key=repr)
    read = lambda df: sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in df.collect()), key=repr)
    assert read(urls.filter_urls(pages, hosts, patterns)) == want
    assert read(urls.filter_urls(pages, hosts, patterns, most=0)) == want
    assert urls.filter_urls(pages.limit(0), hosts, patterns, most=0).count() == 0
