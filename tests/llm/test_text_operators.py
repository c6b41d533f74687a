import hashlib
import json
import random
import re
import time
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricspark.llm import bpe, html_extract, iblt, langid, media


# --- BPE -------------------------------------------------------------------------------------------------------

ODD = [
    "", " ", "ΑΣ ΌΣΟΣ İstanbul ǅ x\u0085y z \x1c a\x1db", "<|endoftext|>Hi<|startoftext|> <|ENDOFTEXT|>", "é ﬁ ½ ²③ Ⅷ don't I'LL we've 'S''s", "日本語 한국어 🙂🙂👩‍👩‍👧", "a" * 3000,
    "​﻿ x", "aaa aaaa aaaaa", "\x00 nul", "ſ K Å", "ßẞ", "abab" * 500, "the of ing of ing",
]


def test_encodes_as_the_library(sf, spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    own = bpe.Vocabulary(bpe.default_path())
    for t, (n, ids, decoded) in zip(texts, own.encode(texts)):
        want = library.encode(t, add_special_tokens=False).ids
        assert (n, ids) == (len(want), " ".join(map(str, want)))
        assert decoded == library.decode(want, skip_special_tokens=False)


def same_as_library(own, library, texts):
    for t, (n, ids, _), want in zip(texts, own.encode(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert (n, ids) == (len(want.ids), " ".join(map(str, want.ids))), t[:200]


def test_every_character_is_what_it_is_in_the_library():
    """All code points, alone and between letters, and letters with random combining marks, later ones included."""
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    own = bpe.Vocabulary(bpe.default_path())
    points = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i <= 0xDFFF]
    for at in range(0, len(points), 100_000):
        some = points[at : at + 100_000]
        same_as_library(own, library, [" ".join(f"{c} Qa{c}b{c}1" for c in some[i : i + 500]) for i in range(0, len(some), 500)])
    rng = random.Random(3)
    marks = [chr(i) for i in range(0x300, 0x11000) if unicodedata.category(chr(i)).startswith("M")]
    letters = [c for c in points[:0x3000] if c.isalpha()]
    made = ["".join([rng.choice(letters), *rng.choices(marks, k=3)]) for _ in range(20_000)] + ["".join(rng.choices(points, k=9)) for _ in range(4000)]
    same_as_library(own, library, made)


def test_forgetting_changes_nothing(monkeypatch):
    own = bpe.Vocabulary(bpe.default_path())
    first = list(own.encode(ODD))
    monkeypatch.setattr(bpe, "REMEMBERED", 2)
    assert [list(own.encode([t]))[0] for t in ODD] == first


def test_forgetting_keeps_what_is_in_use(monkeypatch):
    """Words of each block are learnt once, and those that only earlier blocks had go."""
    own, learnt = bpe.Vocabulary(bpe.default_path()), []
    learn = own.learn
    monkeypatch.setattr(bpe, "REMEMBERED", 2)
    monkeypatch.setattr(own, "learn", lambda chunks: learnt.append(sorted(chunks)) or learn(chunks))
    for block in (["the same words"], ["the same words", "and more"], ["more"]):
        list(own.encode(block))
    assert learnt == [["same", "the", "words"], ["and", "more"], []] and set(own.known) == {"more"}


def test_plain_chunks_need_no_library(monkeypatch):
    """Chunks of visible ASCII and common letters are split without a call of the library's, and into the same words."""
    own = bpe.Vocabulary(bpe.default_path())
    letters = [c for c in map(chr, range(33, bpe.LETTERS)) if own.plain(c)]
    assert set("azAZ09'.~éÉßñДжλ") <= set(letters) and not set("Σ\x7f\u0300²½") & set(letters)
    pairs = " ".join(a + b for a in letters for b in letters)
    assert own.normalise(pairs) == pairs.lower()
    rng = random.Random(5)
    chunks = ["".join(rng.choices(some, k=rng.randint(1, 9))) for some in (letters, "abé'stvrelmd", "aZ9.'!é") for _ in range(5000)]
    want = [[t[i:j] for _, (i, j) in own.pieces(t)] for t in map(own.normalise, chunks)]
    called = []
    for name in ("normalise", "pieces"):
        monkeypatch.setattr(own, name, lambda text, f=getattr(own, name): called.append(text) or f(text))
    assert [own.words(c) for c in chunks] == want and called == []
    assert own.words("aΣ²") == ["aσ", "²"] and called


def test_other_patterns_go_through_the_library(tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    with open(bpe.default_path(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] = {"Regex": r"\p{L}{1,3}|[^\s\p{L}]"}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    same_as_library(bpe.Vocabulary(str(path)), tokenizers.Tokenizer.from_file(str(path)), ODD)


@pytest.mark.parametrize("many", [0, 10**9])
def test_either_way_of_merging(monkeypatch, many):
    """All lists of places as arrays, or all one by one."""
    tokenizers = pytest.importorskip("tokenizers")
    monkeypatch.setattr(bpe, "MANY", many)
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choices("aeinorst", k=rng.randint(1, 12))) for _ in range(300)) for _ in range(20)]
    same_as_library(bpe.Vocabulary(bpe.default_path()), tokenizers.Tokenizer.from_file(bpe.default_path()), ODD + texts)


def test_encoded_rows(odd, none):
    rows = bpe.encode(odd).collect()
    assert len(rows) == odd.count() and all(r["n_tokens"] == len(r["ids"]) for r in rows)
    assert {(r["n_tokens"], r["decoded"]) for r in rows if r["doc_id"] in (2, 3, 4)} == {(0, "")}
    digests = {r["doc_id"]: r for r in bpe.encode(odd, digests=True).collect()}
    for r in rows:
        if r["doc_id"] not in (7,):
            assert digests[r["doc_id"]]["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest()
    assert bpe.encode(none).count() == 0


# --- fingerprints ------------------------------------------------------------------------------------------------


def test_peeling_recovers_the_difference():
    rng = np.random.default_rng(1)
    for n, extra in ((0, 0), (1, 0), (5, 3), (40, 100), (3000, 5), (800, 900)):
        shared, a, b = (rng.integers(1, 2**63, k, dtype=np.uint64) for k in (n, extra, extra // 2))
        x, y = np.concatenate([shared, a]), np.concatenate([b, shared])
        only_x, only_y = iblt.differing(x, y)
        assert set(only_x.tolist()) == set(a.tolist()) and set(only_y.tolist()) == set(b.tolist())


def test_a_sketch_too_small_says_so():
    d = np.arange(1, 500, dtype=np.uint64)
    assert iblt.Sketch(12).add(d).peel() is None


def test_repeats_are_paragraphs_of_their_own():
    assert iblt.likeness(iblt.digests("a.\na.\na."), iblt.digests("a.")) == pytest.approx(1 / 3)
    assert iblt.likeness(iblt.digests(""), iblt.digests(None)) == 1.0


def brute_compare(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1] or ""
        t = t or ""
        changed = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        near = []
        for other in (changed, nxt):
            a, b = set(iblt.digests(t).tolist()), set(iblt.digests(other).tolist())
            near.append(len(a & b) / len(a | b) if a | b else 1.0)
        out[d] = (len(t), hashlib.sha256(changed.encode()).hexdigest(), *near)
    return out


def test_neighbours_against_brute_force(spark, sf, monkeypatch):
    monkeypatch.setattr(iblt, "SAMPLED", 8)  # stretches of unlike sizes
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: (r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in iblt.compare(docs).collect()}
    want = brute_compare([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert got.keys() == want.keys()
    for d, w in want.items():
        assert got[d][:2] == w[:2] and got[d][2:] == pytest.approx(w[2:])


def test_repeated_ids_are_cut_by_their_texts(spark):
    """One id and none at all on most rows: each row is followed by the next in the order of id and hash, whatever the stretches."""
    docs = spark.createDataFrame([(None if i % 3 else 5, f"text {i}. " * 9) for i in range(600)] + [(9, "first")], "doc_id long, text string")
    sizes = [r["n"] for r in iblt.neighbours(docs).where("not lead").groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 601 and max(sizes) <= 2 * min(sizes)
    keys = {r["text"]: (r["k"], r["h"]) for r in docs.select("text", *(c.alias(n) for c, n in zip(iblt._order(), "kh"))).collect()}
    order = sorted(keys, key=keys.get)
    want = sorted(hashlib.sha256(iblt.edited(t, order[(i + 1) % len(order)]).encode()).hexdigest() for i, t in enumerate(order))
    assert sorted(r["edited_sha256"] for r in iblt.compare(docs).collect()) == want


def test_odd_rows_have_fingerprints(odd, none):
    rows = iblt.compare(odd).collect()
    assert len(rows) == odd.count()
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (1, 6)}) == 1
    assert all(0 <= r[c] <= 1 for r in rows for c in ("near_edited", "near_next"))
    assert iblt.compare(none).count() == 0
    one = odd.where("doc_id = 8")
    assert iblt.compare(one).collect()[0]["near_next"] == 1.0


# --- media -------------------------------------------------------------------------------------------------------


def test_payloads_come_back():
    rng = np.random.default_rng(2)
    for p in [b"", b"\xff" * 700, bytes(range(256)) * 9, rng.integers(0, 256, 50_000, dtype=np.uint8).tobytes(), "été 🙂".encode()]:
        got, counts = media.read(media.store(p))
        assert got == p + b"\0" * (-len(p) % 64 if p else 64)
        assert (counts.sum(axis=1) == media.SIDE**2).all()


def test_the_general_decoder_agrees(monkeypatch):
    frame = media.frames_of(bytes(range(64)) * 11)[0]
    fast = media.coefficients(frame)
    monkeypatch.setattr(media, "_OWN", {})
    assert (media.coefficients(frame) == fast).all()


def test_pixels_are_the_inverse_transform():
    rng = np.random.default_rng(4)
    c = rng.integers(-40, 40, (8, 64))
    got = media.pixels(c)
    dc = np.cumsum(c[:, 0].reshape(-1, media.ROW), axis=1).ravel()
    for k in range(8):
        grid = np.zeros((8, 8))
        for i, v in enumerate([dc[k], *c[k, 1:]]):
            grid[media.ZIGZAG[i] // 8, media.ZIGZAG[i] % 8] = v
        a = np.array([[(np.sqrt(1 / 8) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
        want = np.clip(np.round(a.T @ grid @ a + 128), 0, 255)
        assert np.abs(got[k].reshape(8, 8).astype(int) - want).max() <= 2


def test_shots_are_where_histograms_jump():
    calm, other = np.array([900, 100] + [24] * 14 * 0 + [0] * 14), np.array([0] * 14 + [500, 500])
    frames = np.array([calm + np.roll(np.eye(16, dtype=int)[0], i % 2) for i in range(6)] + [other] * 6)
    assert media.shots(frames) == [(0, 6), (6, 12)]


def test_broken_files_are_refused():
    data = bytearray(media.store(b"x" * 100))
    with pytest.raises(ValueError):
        media.indexed(bytes(data[:8]) + b"WAVE" + bytes(data[12:]))


def test_films_and_clips(odd, none):
    rows = media.films(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        payload = media.read(bytes(r["media"]))[0]
        assert hashlib.sha256(payload).hexdigest() == r["payload_sha256"] and not payload[r["n_bytes"] :].strip(b"\0")
        assert hashlib.sha256(bytes(r["media"])).hexdigest() == r["media_sha256"] and len(r["media"]) == r["media_bytes"]
    assert {r["payload_bytes"] for r in rows if r["doc_id"] in (2, 3)} == {64}
    cuts = media.clips(odd).where("doc_id = 5").orderBy("clip").collect()
    assert cuts[0]["start_ms"] == 0 and all(a["end_ms"] == b["start_ms"] for a, b in zip(cuts, cuts[1:]))
    assert media.films(none).count() == 0 and media.clips(none).count() == 0


# --- languages -----------------------------------------------------------------------------------------------------


def test_binding_is_the_product_of_turned_letters():
    s = langid.Space(64, 1)
    got = s.bundle(["ab"])[0]
    v = {c: s.vectors[s.number[ord(c)] - 1].astype(int) for c in " ab"}
    tri = lambda x, y, z: np.roll(v[x], 2) * np.roll(v[y], 1) * v[z]
    assert (got == tri(" ", "a", "b") + tri("a", "b", " ")).all()
    assert not s.bundle(["12 34!"])[0].any()


def test_batches_and_many_letters_change_nothing():
    texts = ["Hello there", "", "été", "".join(chr(0x4E00 + i) for i in range(600)), "x " * 3000]
    a = langid.Space(128, 1).bundles(texts)
    b = np.concatenate([langid.Space(128, 1).bundles([t]) for t in texts])
    assert np.allclose(a, b)


def test_held_out_languages(spark, sf, odd, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.9
    rows = {r["doc_id"]: r for r in langid.identify(odd).collect()}
    assert {rows[d]["lang_pred"] for d in (2, 3, 4, 8)} == {"und"}
    assert langid.identify(none).count() == 0
    unlabelled = odd.withColumn("lang", odd.lang.substr(9, 1)).where("lang is null or lang = 'never'")
    assert {r["lang_pred"] for r in langid.identify(unlabelled).collect()} <= {"und"}


# --- pages -----------------------------------------------------------------------------------------------------------


def wanted(page):
    inner = page[page.index("<article>") + 9 : page.index("</article>")]
    import html

    parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", b))).strip() for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(p for p in parts if p)


def test_articles_of_the_tables(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r for r in html_extract.main_text(pages).collect()}
    for r in pages.collect():
        assert got[r["page_id"]]["text"] == wanted(r["html"]) and got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


def pages_of(spark, rows):
    frame = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "page_id long, url string, html string, h string, low string, n_chars int")
    return {r["page_id"]: r["text"] for r in html_extract.main_text(frame).collect()}


def test_structures(spark):
    x = html_extract.extract
    assert x(None) == x("") == ""
    assert x("plain  text &amp; more") == "plain text & more"
    assert x("</div></p>stray<table><tr><td>1<td>2<tr><td>3</table>") == "stray\n1\n2\n3"
    assert x("<p>open <b>never <i>closed") == "open never closed"
    assert x("<script>only") == "" and x("<SCRIPT>a</sCript x>b") == "b" and x("<p>1 < 2 & 3 <4</p>") == "1 < 2 & 3 <4"
    assert x("<dl><dt>a<dd>b<dt>c</dl><ul><li>1<ul><li>2</ul><li>3</ul>") == "a\nb\nc\n1\n2\n3"
    rows = [
        '<body><div class="site-menu">m</div><div>Hello&nbsp;<b>w</b>orld<br>x</div>tail<p>a<p>b<ul><li>1<li>2</ul><div id="comments"><p>c</p></div></body>',
        "<main><header>h</header><p>t</p></main><footer>f</footer>", "<article><header><h1>T</h1></header><p>a</p><form>f</form></article><div class=ad>out</div>",
        "<article><p title='a > b'>q<script>if (a<b) {}</script><!-- <p>no</p> -->z</article>", '<div class="content no-sidebar">story</div><div class="main-menu">m</div>', "<main><div>story</div><article>teaser</article></main>", None, "",
    ]
    got = pages_of(spark, [(i, f"http://h{i}.example/", r) for i, r in enumerate(rows)])
    assert [got[i] for i in range(len(rows))] == ["Hello world x\ntail\na\nb\n1\n2", "h\nt", "T\na", "qz", "story", "story\nteaser", "", ""]


def site(n, story, frame="<span>About us</span><span>Jobs</span>", host="site.example"):
    return [(i, f"http://{host}/{i}", f'<body><div class="x1">{frame}</div><div class="x2">{story(i)}</div></body>') for i in range(n)]


def test_a_site_gives_its_frame_away(spark):
    rows = site(20, lambda i: f"<p>story {i} says a lot</p><p>and more of one{i}</p>")
    rows += [(100, "http://lone.example/", site(1, lambda i: "<p>a lone story</p>")[0][2]), (101, None, None), (102, "::bad::", "<p>x</p>")]
    got = pages_of(spark, rows)
    assert got[3] == "story 3 says a lot\nand more of one3"
    assert got[100] == "a lone story"  # by the tree of all hosts
    assert got[101] == "" and got[102] == "x"
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.main_text(empty).count() == 0


def test_copies_are_no_template(spark):
    """Nine of ten pages of a host are copies of one: the copies and the others keep their texts."""
    rows = site(60, lambda i: f"<p>a story {i} {'of its own' if i % 10 == 0 else ''}</p>".replace(f" {i}", f" {i}" if i % 10 == 0 else "") + "<p>" + ("long copied text " * 9 if i % 10 else f"the rest of page {i}, longer than all else here") + "</p>")
    got = pages_of(spark, rows)
    assert got[1] == "a story\n" + ("long copied text " * 9).strip()
    assert got[10] == "a story 10 of its own\nthe rest of page 10, longer than all else here"


def test_the_tree_overrules_what_elements_say(spark):
    """In an article, what all of a host's pages have goes; an unnamed frame goes, too."""
    rows = [(i, f"http://big.example/{i}", f"<div>Our shop sells hats</div><article><p class=body>text {i} is long enough to be the longest one</p><p class=line>Like what you read? Tell others.</p></article>") for i in range(200)]
    got = pages_of(spark, rows)
    assert {got[i] for i in range(200)} == {f"text {i} is long enough to be the longest one" for i in range(200)}


def test_the_tree_alone_finds_the_articles(spark, sf):
    """Without what elements say of themselves nearly all pages come out right; without the tree none."""
    pages = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.1')}/pages.parquet")
    want = {r["page_id"]: (wanted(r["html"]), html_extract.extract(r["html"])) for r in pages.collect()}
    got = {r["page_id"]: r["text"] for r in html_extract.main_text(pages, names=False).collect()}
    assert np.mean([got[i] == w for i, (w, _) in want.items()]) >= 0.9
    assert np.mean([e == w for w, e in want.values()]) < 0.01


def test_importances_against_plain_counts(spark):
    """The entropies of a small site by loops over its pages."""
    rows = [(i, f"http://s.example/{i}", f"<div>{'same' if i % 4 else 'other'}</div><p>unlike text {i} here</p>") for i in range(12)]
    got = {r["path"]: r["importance"] for r in html_extract.importances(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for tag, features in (("div", ["same" if i % 4 else "other" for i in range(12)]), ("p", [str(i) for i in range(12)])):
        entropy = np.mean([np.log(features.count(f)) / np.log(12) for f in features])
        path = next(n.path for n in html_extract.Page(rows[0][2]).nodes if n.style == tag)
        assert got[path] == pytest.approx(html_extract.GAMMA * (1 - entropy) + (1 - html_extract.GAMMA) * 0.0)


def test_hostile_pages_take_time_with_their_length():
    n = 100_000
    for p in ('<a "' * n, '<a x="' * n, "<div></b></i>" * n, "<i>" * n + "<li>" * n, "<li><i>" * n, "<table>" + "<tr><td>" * n, "<" * n, "<a x='" + '<b y=">' * n, "<!-- " * n, "<script></SCRIPT x>" * n):
        began = time.perf_counter()
        page = html_extract.Page(p)
        page.observations()
        page.blocks()
        assert time.perf_counter() - began < 20, p[:20]
