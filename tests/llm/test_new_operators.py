"""Merkle manifests, HTML extraction and conversation repair against plain Python."""

import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree long, row long, key string, n long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(leaves):
    """The root and each leaf's siblings as (side, digest)."""
    level, at, proofs = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for i, p in enumerate(at):
            q = p ^ 1
            proofs[i].append(("none", "") if q >= len(level) else ("left" if q < p else "right", level[q]))
        level = [H(*level[i : i + 2]) for i in range(0, len(level), 2)]
        at = [p // 2 for p in at]
    return level[0], proofs


def plain_manifest(rows):
    """[(doc_id, leaf, subroot, root, siblings)] of rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0], H(*map(encoded, r))))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in order:
        held = sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append((held, *plain_tree([h for _, h in held])))
    if not trees:
        return []
    root, beyond = plain_tree([t[1] for t in trees])
    return [(i, h, sub, root, proof + up) for (held, sub, proofs), up in zip(trees, beyond, strict=True) for (i, h), proof in zip(held, proofs, strict=True)]


def rows_of(n, seed=0):
    rng = random.Random(seed)
    out = [(rng.choice([i, i, i, None]), f"s{i % 3}", rng.choice(["en", "en", "en", "de", None, "é"]), rng.choice([i, None]), "tüxt " * (i % 4)) for i in range(n)]
    return [*out, out[0], out[0], out[1], (5, None, "one", 1, None)] if out else []


@pytest.mark.parametrize("n", [0, 1, 60, 700])
def test_manifest_equals_a_plain_tree(spark, monkeypatch, n):
    from quire.llm import merkle

    monkeypatch.setattr(merkle, "BLOCK_BITS", 2 if n < 100 else 4)
    rows = rows_of(n) if n != 1 else [(7, "s", "en", 3, "x" * 3_000_000)]
    df = spark.createDataFrame([(i, t, g, s, c, 1, 2, "clash", 3) for i, s, g, c, t in rows], DOCS).repartition(3)
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    found = merkle.manifest(df, F.col("doc_id"), fields, F.col("lang"))
    got = [(r["key"], r["leaf"], r["subroot"], r["root"], [(s["side"], s["digest"]) for s in r["siblings"]]) for r in found.collect()]
    want = plain_manifest(rows)
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert found.where(merkle.fold(F.col("leaf"), F.col("siblings")) != F.col("root")).count() == 0
    assert found.where(merkle.fold(F.sha2(F.lit("other"), 256), F.col("siblings")) == F.col("root")).count() == 0


def test_manifest_query_marks_tampered_rows(spark, tmp_path):
    from quire.llm.queries import QUERIES

    rows = rows_of(90, 3)
    spark.createDataFrame([(i, t, g, s, c) for i, s, g, c, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["op11_merkle_manifest"](spark, str(tmp_path)).collect()
    want = {(i, leaf): (sub, root, H(*[d for _, d in sib])) for i, leaf, sub, root, sib in plain_manifest(rows)}
    nulls = {(i, H(*map(encoded, (i, s, g, c, t)))) for i, s, g, c, t in rows if c is None}
    for r in found:
        sub, root, proof = want[r["doc_id"], r["leaf"]]
        tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and (r["doc_id"], r["leaf"]) not in nulls
        assert (r["subroot"], r["root"]) == (sub, root) and r["verified"] == (not tampered) == (r["folded_root"] == root)
        if rows.count(next(x for x in rows if (x[0], H(*map(encoded, x))) == (r["doc_id"], r["leaf"]))) == 1:
            assert r["proof_sha256"] == proof


# ---------------------------------------------------------------- HTML

ARTICLE = "<h1>Short</h1><p><b>One &amp; two.<br><p>Three&nbsp;four<p>Of.</p>"
PAGES = [
    (f"<!DOCTYPE html><head><title>T</title><script>var a='<p>x</p>'</script></head><body class='has-sidebar'><nav><ul><li><a href=/a>a</a></ul></nav><!-- c --><div class=ad>Buy.</div><article>{ARTICLE}</article><footer>&copy; x</footer>", "Short One & two. Three four Of."),
    (f"<header><h1>Site</h1></header><main><article><header><h1>Head</h1></header><p>Body text.</p><aside>Side</aside><form><input>Mail</form></article><section id='comments'><article class=comment><p>{'Nice. ' * 90}</article></section></main>", "Head Body text."),
    ("<div class='cookie-notice'>We use cookies. " + "Really. " * 40 + "</div><div id=content><h2>Title</h2><p>" + "Long text. " * 30 + "</p><p>End.</p></div><div><div><div>Copyright 2020 us</div></div></div>", "Title " + "Long text. " * 30 + "End."),
    ("", ""), (None, ""), ("<nav>Menu</nav><footer>Foot</footer>", ""), ("plain words only", "plain words only"), ("a &am b &lt;c&gt; 1 < 2", "a &am b <c> 1 < 2"),
    ("<form id=aspnet><article><p>Inside.</p></article></form>", "Inside."), ("<p>Kept.</p><script>never closed <p>x", "Kept."), ("<p>Kept.<!-- open <p>x", "Kept."),
    ("<article><p title='a>b' class=\"x\">Quoted.</p><span class=ad>Ad <span>in</span> it</span> tail<p style='display: none'>hid</p></article>", "Quoted. tail"),
    ("<article><ul><li>One<li>Two <ul><li>Deep</ul><li>Three</ul><table><tr><td>a<td>b<tr><td>c</table></article>", "One Two Deep Three a b c"),
    ("<div class=tagline>News.</div><div id=content><p>Tiny.</p><div class='promo-box'>Buy</div><p>End.</p></div><section aria-label='Reader comments'><p>First!</p></section>", "Tiny. End."),
    ("<div class=box><div class=content>Small.</div></div><div class=text><p>" + "Long text goes on. " * 20 + "</p></div>", "Long text goes on. " * 20),
    ("<main><h1>T</h1><div itemprop='articleBody'><p>Body.</p></div><div class='comments-area'><p>Me too.</p></div></main>", "Body."),
    ("<article><p>A</p><!-- x --><script>1<2</script><aside>s</aside><div class='ad-slot'>ad</div><footer>f</footer><table><tr><td>c</td></tr></table><pre>p  q</pre><blockquote>b</blockquote>z &amp;lt; y</article>", "A c p q b z &lt; y"),
    ("<article><div class=entry-header><h1>H</h1></div><div role=navigation>n</div>x</article>", "H x"),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_main_text(page, text):
    from quire.llm.html_extract import main_text

    assert main_text(page) == text.strip()


def test_main_text_is_linear_and_whole():
    from quire.llm.html_extract import main_text

    many = "".join(f"<p>para {i}</p>" for i in range(200_000))
    assert main_text(f"<article>{many}</article>") == " ".join(f"para {i}" for i in range(200_000))
    assert main_text("<article><h1>a<p>b<h2>c<p>d<li>e<h1>f</article>") == "a b c d e f"
    for nasty in ("<h1><p>" * 50_000, "<li><p>" * 50_000, "<td><tr><li>" * 30_000, "<div>" * 50_000 + "x", "<p a='" * 50_000, "<b>" * 50_000 + "</i>" * 50_000, "</p>" * 50_000, "<a href=x>" * 50_000, "<h1>" * 50_000 + "x", "&" * 200_000):
        main_text(nasty)


def test_lengths_alone_find_the_article():
    from quire.llm.html_extract import surges

    assert surges([5, 0, 0, 0, 40, 60, 9, 0, 0, 0, 7]) == [(3, 7)]
    assert surges([]) == [] and surges([0, 0]) == [] and surges([3]) == [(0, 1)]


def test_extraction_keeps_rows_and_columns(spark):
    from quire.llm.html_extract import extract_main_text

    rows = [(i, "u", h, "old", 1, "extra") for i, (h, _) in enumerate(PAGES)] + [(None, None, None, None, None, None), (0, "u", PAGES[0][0], "old", 1, "extra")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int, _c string")
    found = extract_main_text(df)
    assert found.columns == ["page_id", "url", "_c", "text", "n_chars"]
    got = sorted((r["page_id"] is not None, r["page_id"] or 0, r["text"], r["n_chars"]) for r in found.collect())
    assert got == sorted((r[0] is not None, r[0] or 0, t.strip(), len(t.strip())) for r, t in zip(rows, [*[t for _, t in PAGES], "", PAGES[0][1]], strict=True))
    assert extract_main_text(df.where("false")).count() == 0


# ---------------------------------------------------------------- conversations


def plain_repair(rows):
    """(cost, audit, repaired) by trying every sequence of edits; rows: (role, text, fault)."""
    best = (3 * len(rows), "D" * len(rows), [])
    word = {"u": "user", "a": "assistant"}

    def ok(roles):
        body = roles[1:] if roles[:1] == "s" else roles
        return roles == "" or (body and len(body) % 2 == 0 and body == "ua" * (len(body) // 2))

    def walk(i, cost, audit, made, inserts):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(rows) and ok("".join(r[:1] if r else "?" for r, _ in made)):
            best = min(best, (cost, audit, list(made)))
        if inserts < 2:
            for r in "ua":
                walk(i, cost + 2, audit + "I", [*made, (word[r], "")], inserts + 1)
        if i < len(rows):
            role, text, fault = rows[i]
            walk(i + 1, cost + 3, audit + "D", made, 0)
            if fault not in ("b", "d"):
                late = fault == "t"
                walk(i + 1, cost + late, audit + "K", [*made, (role, text)], 0)
                for r in "ua":
                    walk(i + 1, cost + 2 + late, audit + "R", [*made, (word[r], text)], 0)

    walk(0, 0, "", [], 0)
    return best


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        t = text.strip(" \t\n\v\f\r")
        out.append((role, text, "b" if not t else "d" if (role, text) in seen else "." if t[-1] in ".!?" else "t"))
        seen.add((role, text))
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string, row long, digest string, segment int"


@pytest.mark.parametrize("segment", [1, 2, 1024])
def test_repair_equals_trying_every_edit(spark, monkeypatch, segment):
    from quire.llm import repair

    monkeypatch.setattr(repair, "SEGMENT", segment)
    rng = random.Random(segment)
    held = {i: [(t, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", "ugly"]), rng.choice(["A.", "B!", "c", " \n", "D?", f"x{t}.", ""])) for t in sorted(rng.sample(range(9), rng.randint(1, 4)))] for i in range(50)}
    held[100] = [(None, "user", "q?"), (None, "user", "q?"), (3, None, None), (3, "assistant", "a.")]
    held[None] = [(1, "user", "u."), (2, "assistant", "a.")]
    rows = [(i, t, r, x, 1, "clash", 2) for i, turns in held.items() for t, r, x in turns]
    report, repaired = repair.repair(spark.createDataFrame(rows, CONVERSATIONS).repartition(3))
    found, digests = {r["conv_id"]: r for r in report.collect()}, {r["conv_id"]: r["repaired_sha256"] for r in repair.repaired_sha256(repaired).collect()}
    assert set(found) == set(held)
    for i, turns in held.items():
        said = sorted(((t is not None, t or 0, r if r is not None else " ", H(x if x is not None else " "), x if x is not None else " ") for t, r, x in turns))
        known = faults_of([(s[2], s[4]) for s in said])
        cost, audit, made = plain_repair(known)
        r = found[i]
        assert (r["cost"], r["audit"]) == (cost, audit), (i, known)
        assert digests[i] == H("\n".join(f"{a}:{b}" for a, b in made)), (i, known, made)
        assert [r[k] for k in ("blank", "duplicate", "truncated")] == [sum(f == k for *_, f in known) for k in "bdt"]
        initials = [k[0][:1] for k in known]
        assert r["illegal"] == sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        numbers = {t for t, *_ in turns if t is not None}
        assert r["gaps"] == (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0)


def test_repair_of_one_long_conversation(spark):
    """All rows in one conversation, most of them at one turn, over many segments; and a long text."""
    from quire.llm import repair

    df = spark.range(9000).selectExpr("1L AS conv_id", "IF(id < 4000, id, 4000) AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "IF(id < 4000, concat('t', id, '.'), 'same.') AS text")
    df = df.unionByName(spark.createDataFrame([(2, 0, "user", "y" * 5_000_000)], "conv_id long, turn long, role string, text string"))
    report, repaired = repair.repair(df)
    r = {x["conv_id"]: x for x in report.collect()}
    assert r[1]["duplicate"] == 4998 and r[1]["audit"].count("D") == 4998 and len(r[1]["audit"].replace("I", "")) == 9000
    assert (r[2]["cost"], r[2]["audit"]) == (3, "D")
    turns = sorted((x["segment"], x["turns"]) for x in repaired.where("conv_id = 1").collect())
    roles = "".join(t["role"][0] for _, held in turns for t in held)
    assert len(turns) >= 9 and roles == "ua" * (len(roles) // 2)


def test_repair_of_an_empty_table(spark):
    from quire.llm import repair

    report, repaired = repair.repair(spark.createDataFrame([], CONVERSATIONS))
    assert report.count() == 0 and repair.repaired_sha256(repaired).count() == 0


def test_repair_query_returns_conversations_without_rows(spark, tmp_path):
    from quire.llm.queries import QUERIES

    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "a."), (None, None, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    found = {r["conv_id"]: r.asDict() for r in QUERIES["op13_conversation_repair"](spark, str(tmp_path)).collect()}
    assert set(found) == {gone, None}
    assert found[gone] == {"conv_id": gone, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": H("")}


# ---------------------------------------------------------------- earlier operators on ties, prepared measures and long texts


def test_rows_of_one_turn_are_ordered_by_their_text(spark):
    from quire.llm import chat

    rows = [(1, 0, "user", x) for x in ("<b", "1a", "&c", "zz", "<b")]
    found = chat.digest(chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(2))).collect()[0]
    assert found["turns_sha256"] == H("".join(f"user\n{x}\n" for x in sorted(r[3] for r in rows)))


def test_prepared_measures_are_timed_as_they_are_used(spark):
    from quire.llm import quality

    docs = spark.createDataFrame([(i, ("same words here " if i % 2 else "one two # three ") * 40) for i in range(50)], "doc_id long, text string")
    known = docs.withColumn("known", quality.measured(F.col("text"), ("n_words", "n_repeat_words", "word_chars")))
    prepared = {n: F.col("known")[n] for n in ("n_words", "n_repeat_words", "word_chars")}
    plain, ready = quality.estimate(docs), quality.estimate(known, prepared=prepared)
    assert [(n, share) for n, _, share in plain] == [(n, share) for n, _, share in ready]
    judged = [r["failed_rule"] for r in quality.judge_quality(known, prepared=prepared).orderBy("doc_id").collect()]
    assert [x is None for x in judged] == [x["failed_rule"] is None for x in quality.judge_quality(docs).orderBy("doc_id").collect()]


def test_kept_words_are_bounded_by_bytes(monkeypatch):
    from quire.llm import packing

    monkeypatch.setattr(packing, "KEPT_BYTES", 10_000)
    cache, plain = packing.WordCache(packing.vocabulary_path()), packing.WordCache(packing.vocabulary_path())
    texts = [f"a {'long' * 2000}{i} b{i}" for i in range(8)]
    for t in texts:
        assert cache.encode([t]) == plain.encode([t])
        assert sum(len(w) for w in cache.kept) <= 10_000 + len(t)


@pytest.mark.parametrize("long", [2_000_000])
def test_texts_of_megabytes(spark, long):
    """Every operator over documents with one very long text among short ones."""
    from quire.llm import mixing, packing, quality, secrets, sharding, simhash, winnowing

    words = " ".join(f"w{i % 977}x{i % 13}" for i in range(long // 8)) + " password=hunter2hunter2."
    rows = [(1, words, "en", "s", len(words)), (2, "Short text.", "en", "s", 11), (3, None, "de", None, None), (4, words, "en", "t", len(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    near = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert near[1] == near[4] == 1 and near[2] == 2
    spans = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(docs).collect()}
    assert [(s["kind"], s["start"]) for s in spans[1]] == [("assign", words.index("password"))]
    assert {r["doc_id"]: r["size"] for r in sharding.assign_shards(docs, 24).collect()}[1] == len(words) + 8
    assert winnowing.fingerprint_documents(docs).count() == 4 and quality.judge_quality(docs).count() == 4
    assert {r["doc_id"]: r["size"] for r in mixing.mix(docs).collect()}[1] == len(words.split())
    packed = packing.pack(docs, packing.vocabulary_path(), ranks_path=packing.vocabulary_path(packing.RANKS)).collect()
    assert sum(r["length"] for r in packed if r["doc_id"] == 1) == sum(r["length"] for r in packed if r["doc_id"] == 4) > 100_000
