"""The operators against brute force on small fixtures: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scalarlake.llm import bwt, linking, windows
from scalarlake.llm.bwt import repeated_bytes
from scalarlake.llm.common import keep
from scalarlake.llm.decontaminate import Automaton, match, remove_spans, report, split_words
from scalarlake.llm.exact import exact_groups
from scalarlake.llm.html import extract, main_text
from scalarlake.llm.lines import dedup_report, drop_lines, fingerprints, line_key, similar, within
from scalarlake.llm.linking import connected
from scalarlake.llm.minhash import near_duplicates
from scalarlake.llm.mixing import mix_sources
from scalarlake.llm.quality import estimate_prior, fit, measures, quality
from scalarlake.llm.warc import archive_round_trip, read_archives, write_archives
from scalarlake.llm.windows import levels, repeated_windows

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string"


@pytest.fixture(scope="module")
def texts():
    """(doc_id, text) with copies, near copies, shared passages, periods, blanks, nulls and repeated rows."""
    word = lambda k: "w" + hashlib.md5(str(k).encode()).hexdigest()[:5]
    prose = lambda a, n: [word(a * 1000 + k) for k in range(n)]
    passage = " ".join(prose(77, 70))
    rows = []
    for i in range(30):
        body = prose(i, 40 + 7 * i)
        if i % 5 == 0:
            body[10:10] = passage.split()
        rows.append((i, "\n".join(" ".join(body[k:k + 12]) for k in range(0, len(body), 12))))
    base = dict(rows)
    rows += [(40, base[3]), (41, base[3].replace(" ", "  ")), (42, base[3].upper()), (43, base[7] + " tail"), (44, base[20].replace(word(20005), "changed"))]
    rows += [(50, ""), (51, None), (52, "  \n\t"), (53, "a"), (54, "a b"), (55, "ab " * 400), (56, "ab " * 150 + "end"), (57, "ü€😀 " * 90)]
    rows += [(60, " ".join(prose(90, 4000))), (61, base[9]), (61, base[9]), (61, base[8]), (None, base[9]), (None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", ["b", "a", None, "c"][(i or 0) % 4], len(t or ""), "clash") for i, t in texts], SCHEMA).repartition(3)


def unique(texts):
    """Without null ids and without ids of several rows, which per-id comparisons cannot tell apart."""
    n = Counter(i for i, _ in texts)
    return {i: t for i, t in texts if i is not None and n[i] == 1}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([], "item_id bigint, text string")
    for out in (exact_groups(none), mix_sources(none), report(match(none, items)), near_duplicates(none), dedup_report(none), repeated_windows(none),
                repeated_bytes(none), quality(none, spark.createDataFrame([], "doc_id bigint, quality int"))):
        assert out.count() == 0
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert extract(pages).count() == 0 and archive_round_trip(pages).count() == 0


def test_exact(docs, texts):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in texts:
        groups[norm(t)].append(i)
    want = Counter()
    for i, t in texts:
        ids = [x for x in groups[norm(t)] if x is not None]
        keep = min(ids) if ids else None
        want[i, keep, len(groups[norm(t)]), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in exact_groups(docs).collect()) == want


def test_mixing(docs, texts):
    out = mix_sources(docs).collect()
    assert len(out) == len(texts) and sorted(map(repr, out)) == sorted(map(repr, mix_sources(docs).collect()))
    size = Counter()
    for r in out:
        size[r.source] += r["size"]
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    # Excess is handed on by weight until no target is above twice its source.
    target, left, open_ = {}, 1.5 * sum(size.values()), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * size[s]}
        target |= {s: 2 * size[s] if full else weight[s] * level for s in (full or open_)}
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    for s in order:
        rows = [r for r in out if r.source == s]
        assert all(abs(r.target - target[s]) < 1e-6 and r.source_size == size[s] for r in rows)
        assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in rows)
        assert abs(sum(r.taken for r in rows) - target[s]) <= max(r["size"] for r in rows) / 2 + 1e-6


def test_mixing_prefers_quality(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    out = mix_sources(rows, F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0), share=0.5)
    even, odd = (out.where(f"doc_id % 2 = {k} and taken > 0").count() for k in (0, 1))
    assert abs(3 * (even + odd) - 6000) <= 3 and even > 2 * odd


def brute_windows(text, items, size=10):
    words = split_words((text or "").encode())
    hit, ids = [False] * len(words), set()
    for k, item in items:
        own = split_words((item or "").encode())
        for w in {tuple(own[j:j + size]) for j in range(max(1, len(own) - size + 1))} if own else ():
            for p in range(len(words) - len(w) + 1):
                if tuple(words[p:p + len(w)]) == w:
                    hit[p:p + len(w)] = [True] * len(w)
                    ids.add(k)
    return len(words), sum(hit), sorted(str(k) for k in ids if k is not None)


@pytest.mark.parametrize("block_words", [100_000, 25])
def test_decontamination(spark, docs, texts, block_words):
    some = unique(texts)
    items = [(1, some[5]), (2, " ".join(some[6].split()[3:17])), (3, "a"), (4, ""), (5, None), (6, "A, b!"), (7, "zzz"), (None, some[12]), (2, some[13]),
             (8, " ".join(some[9].split()[4:9])), (10, some[55])]
    frame = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: r for r in report(match(docs, frame, block_words=block_words)).collect()}
    for i, t in some.items():
        n, hit, ids = brute_windows(t, items)
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(ids), hit > 0), i
        assert r.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()
    cleaned = remove_spans(docs, frame, block_words=block_words)
    assert cleaned.columns == docs.columns
    rows = {r.doc_id: r.text for r in cleaned.collect()}
    for i, t in some.items():
        n, hit, _ = brute_windows(t, items)
        if not hit:
            assert rows[i] == t
        else:
            assert (i not in rows) == (hit > n / 2) or brute_windows(rows.get(i), items)[1] == 0
            assert i not in rows or brute_windows(rows[i], items)[1] == 0


def test_blocks_of_items_do_not_matter(spark):
    """Coverage, cuts and matches around cuts are those of all items together, however the items are dealt into blocks."""
    word = lambda k, n, a=0: [f"i{k}x{j}" for j in range(a, a + n)]
    free = lambda k, n: [f"f{k}x{j}" for j in range(n)]
    items = [word(k, 12) for k in range(8)]
    items += [word(k, 10, 2) + ["y", "z"] for k in range(8)]  # words 2-11 stand in two items
    items += [free(500 + k, 6) + free(600 + k, 6) for k in range(8)]  # these meet when what is between is cut
    items += [["short", str(k)] for k in range(4)]
    rows = []
    for k in range(8):
        rows.append((k, free(k, 8) + word(k, 10) + word((k + 1) % 8, 10)))  # 20 of 28 words, of two items
        rows.append((10 + k, free(k, 40) + word(k, 12) + ["y", "z"] + free(k, 9)))
        rows.append((20 + k, free(k, 40) + free(500 + k, 6) + word(k, 12) + free(600 + k, 6) + free(k, 9)))
        rows.append((30 + k, free(k, 40) + free(500 + k, 6) + ["short", str(k % 4)] + free(600 + k, 6)))
    rows += [(50, free(9, 30)), (51, []), (52, items[0])]
    docs = spark.createDataFrame([(i, " ".join(w), 1) for i, w in rows] + [(60, None, 1), (None, "short 1 tail end", 1)], "doc_id bigint, text string, spans int")
    frame = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id bigint, text string")
    one, many = (Counter(map(tuple, remove_spans(docs, frame, block_words=n).collect())) for n in (100_000, 80))
    assert many == one
    left = {r[0]: (r[1] or "").split() for r in many}
    assert not {*range(8), 52} & set(left) and len(many) == len(rows) + 2 - 9
    for k in range(8):
        assert left[10 + k] == free(k, 40) + free(k, 9) == left[20 + k] and left[30 + k] == free(k, 40)


def test_automaton_is_exact():
    items = [(k, w.split()) for k, w in enumerate(["a b a b a", "b a b c", "a a a a", "c", "a b c a b c a b"])]
    automaton = Automaton([(k, [x.encode() for x in w]) for k, w in items], 3)
    for text in ("a b a b a b c a", "c c a a a a a", "x a b x", "a b c a b c a b c"):
        hit, ids = automaton.scan([x.encode() for x in text.split()])
        n, want, names = brute_windows(text, [(k, " ".join(w)) for k, w in items], 3)
        assert (0 if hit is None else int(hit.sum()), sorted(str(automaton.ids[k]) for k in ids)) == (want, names)


def test_html():
    page = ("<html><head><title>t</title><style>p{}</style></head><body><nav><a href=x>menu</a></nav><script>var a='</p>';</script>"
            "<article><h1>Head &amp;  line</h1><p><b>First\n para.<br><p>Second &eacute;.</p></article><div class='ad'>Buy</div>"
            "<section id=comments><p>reader</p></section><footer>foot</footer>")
    assert main_text(page) == "Head & line\nFirst para.\nSecond é."
    assert main_text(None) == main_text("") == main_text("<p></p><script>x") == ""
    plain = "<div><a href=a>one</a></div>" + "".join(f"<p>{'word ' * 30}{k}</p>" for k in range(4)) + "<div><a href=b>two</a></div>"
    assert main_text(plain).count("\n") == 3 and "one" not in main_text(plain) and "two" not in main_text(plain)
    assert main_text("<p>short") == "short"


def test_html_marks():
    """Attributes are read by name and marks are whole tokens; what holds the article is not hidden."""
    body = f"<p>{'word ' * 30}end</p>"
    for shown in ('style="overflow:hidden"', 'class="overflow-hidden"', 'aria-hidden="false"', "class=no-sidebar", "class='page has-sidebar'",
                  'class="comments-open"', "data-hidden=1", 'title="hidden display:none"', "style='display:none;display:block'"):
        assert main_text(f"<div {shown}>{body}</div>").endswith("end"), shown
        assert main_text(f"<article><div {shown}>{body}</div></article>").endswith("end"), shown
        assert main_text(f"<div {shown}><article>{body}</article></div>").endswith("end"), shown
    for gone in ("hidden", "HIDDEN=''", 'aria-hidden="true"', "style='color:red; display : none !important'", "class='x sidebar'", "id=comments",
                 "class=ad-banner", "class=site_footer", "role=navigation"):
        assert main_text(f"<article><p>kept</p><div {gone}>{body}</div></article>") == "kept", gone
    for head in ("<header class='entry-header'>", "<header class=header>", "<div class='article-header'>", "<div class=header>"):
        assert main_text(f"<article>{head}<h1>Headline</h1></{head[1:].split()[0]}>{body}</article>").startswith("Headline"), head
    for wrapper in ("div class=sidebar", "form", "div hidden", "section id=comments"):
        name = wrapper.split()[0]
        assert main_text(f"<{wrapper}><nav>menu</nav><article>{body}<div class=ad>Buy</div></article></{name}>") == "word " * 30 + "end"
    cards = f"<article>{body}</article><aside><article>{body.replace('end', 'card')}{body}</article></aside>"
    assert main_text(cards).count("end") == 1 and "card" not in main_text(cards)
    thread = f"<div>{body}{body}</div><section id=comments><article>{'reader ' * 20}</article></section>"
    assert "reader" not in main_text(thread)


def test_html_implied_ends():
    """Elements that an end tag is left out for hide nothing of what follows."""
    for page in ("<p class=ad>Buy<p>one<p>two", "<p class=ad>Buy<div>one</div><p>two", "<p class=ad>Buy<h2>one</h2>two", "<p class=ad><b>Buy<ul><li>one<li>two</ul>",
                 "<ul><li class=ad>Buy<li>one<li>two</ul>", "<ul><li class=ad><p>Buy<ul><li>Sell</ul><li>one<li>two</ul>", "<dl><dt class=ad>Buy<dd>one<dt>two</dl>",
                 "<table><tr><td class=ad>Buy<td>one<tr class=ad><td>Buy<tr><td>two</table>", "<table><tr class=ad><td>Buy<tbody><tr><th>one<td>two</table>",
                 "<h2 class=ad>Buy<h3>one</h3>two", "<a class=ad>Buy<a>one</a><p>two", "<p class=ad>Buy<hr>one<p>two", "<head><title>t</title><body>one<p>two",
                 "<head><meta charset=x><p>one<p>two", "<head><title>t</title>one<p>two"):
        assert main_text(f"<article>{page}</article>" if "<head>" not in page else page).split() == ["one", "two"], page
    # An item stays open over lists, and a paragraph over tables' cells, that it holds.
    assert main_text("<article><ul><li class=ad>Buy<ul><li>Sell</ul>Rent</ul>one<p>two</article>").split() == ["one", "two"]
    assert main_text("<article><table><tr class=ad><td><table><tr><td>Buy</table>Sell</table><p>one").split() == ["one"]


def test_html_without_article():
    """Lists, headings and short last paragraphs do not divide an article that no element marks."""
    long = lambda k: f"long{k} " + "word " * 30 + "end"
    short = [f"point {k} of twenty" for k in range(3)]
    items = "".join(f"<li>{x}</li>" for x in short)
    menu = "<ul>" + "".join(f"<li><a href=x>menu entry {k}</a></li>" for k in range(5)) + "</ul>"
    for a, b in (("", ""), ("<div class=body>", "</div>"), ("<table><tr><td>", "</td></tr></table>")):
        page = f"{menu}{a}<h1>Head</h1><p>{long(0)}</p><ul>{items}</ul><h2>Part</h2><p>{long(1)}</p><p>Last words.</p>{b}{menu}"
        assert main_text(page).split("\n") == ["Head", long(0), *short, "Part", long(1), "Last words."], a
        page = f"{menu}{a}<p>{long(0)}</p>{menu}<p>{long(1)}</p>{b}{menu}"
        assert {long(0), long(1)} <= set(main_text(page).split("\n")) and not main_text(page).endswith("4"), a
    parts = f"{menu}<div><div><p>{long(0)}</p></div><ul>{items}</ul><div><p>{long(1)}</p></div></div>{menu}"
    assert main_text(parts).split("\n") == [long(0), *short, long(1)]
    other = f"{menu}<div><p>{long(0)}</p><p>{long(1)}</p></div>{menu}<div><p>{long(2)}</p></div><div>Imprint</div>"
    assert main_text(other).split("\n") == [long(0), long(1)]
    assert main_text(f"<div><p>{long(0)}</p><p>Bye.</p></div><div>Imprint</div>").split("\n") == [long(0), "Bye."]


def test_extract_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>", 1), (1, "u", "<p>a</p>", 2), (None, None, None, 3)], "page_id bigint, url string, html string, text int")
    assert sorted(extract(pages).collect(), key=repr) == sorted([(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0)], key=repr)


def test_extract_breaks(spark):
    """Two line breaks stand between blocks, with and without <article>, and are counted."""
    pages = [(1, "<article><h1>a</h1><p>b<br>c</p></article>"), (2, "<p>a<p>b c"), (3, f"<p>a</p><p>{'x' * 90}</p>")]
    got = extract(spark.createDataFrame([(i, "u", h) for i, h in pages], "page_id bigint, url string, html string")).collect()
    want = {1: "a\n\nb c", 2: "a\n\nb c", 3: "a\n\n" + "x" * 90}
    assert {r.page_id: (r.text, r.n_chars) for r in got} == {i: (t, len(t)) for i, t in want.items()}


def test_quality(spark):
    import random
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(900):
        words = ["".join(rng.choice("abcdefghi") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 80))]
        bad = i % 6 == 0
        rows.append((i, " ".join(w.upper() + "!!" if bad else w for w in words)))
        if rng.random() < 0.4:
            labels.append((i, int(not bad)))
    rows += [(5000, None), (5001, ""), (None, "abc def")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("score", F.lit("clash"))
    out = quality(docs, spark.createDataFrame(labels + [(None, 1), (3, None), (77777, 1)], "doc_id bigint, quality int")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.predicted == int(r.score >= 0.7)
    right = [r.predicted == int(r.doc_id % 6 != 0) for r in out if r.doc_id is not None and r.doc_id < 900 and r.held_out]
    assert sum(right) / len(right) > 0.97
    assert fit(__import__("numpy").zeros((0, 17)), __import__("numpy").zeros((3, 17))).prior == 0.5
    assert len(measures(None)) == len(measures(b"a b")) == 17


def test_prior():
    import numpy as np
    rng = np.random.default_rng(1)
    p, u = rng.normal(3, 1, 4000), np.concatenate([rng.normal(3, 1, 2800), rng.normal(-3, 1, 1200)])
    assert abs(estimate_prior(p, u) - 0.7) < 0.05


def test_warc(spark, tmp_path):
    big, other = "é" * 60 + "x" * 100, "y" * 300
    pages = [(3, "u3", big), (1, "u1", big), (2, None, "small"), (4, "u4", "small"), (5, "u\r\n5", None), (6, "u6", ""), (7, "u7", other), (None, "n", other),
             (8, "u8", "r\r\n\r\nWARC/1.0\r\n" * 20), (1, "u1", big)]
    frame = spark.createDataFrame([(*p, 1) for p in pages], "page_id bigint, url string, html string, record_type int")
    got = Counter(tuple(r) for r in archive_round_trip(frame).collect())
    want = Counter()
    for i, _, h in pages:
        b = (h or "").encode()
        ids = [x for x, _, y in pages if y == h and x is not None]
        revisit = len(b) >= 100 and min(ids) != i
        want[i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", min(ids) if revisit else None] += 1
    assert got == want
    archives = write_archives(frame, f"file://{tmp_path}/w", archive_bytes=1)
    assert archives.count() == len(pages)
    payloads = {r.page_id: bytes(r.payload) for r in read_archives(archives).collect() if r.record_type == "response"}
    assert payloads[8] == pages[8][2].encode() and payloads[1] == big.encode()


def components(nodes, linked):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    nodes = sorted(nodes)
    for k, a in enumerate(nodes):
        for b in nodes[:k]:
            if find(a) != find(b) and linked(a, b):
                up[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_connected(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (30, 30), (None, 4), *((k, k + 1) for k in range(100, 160))]
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {n: 1 for n in (1, 2, 3, 7, 8, 9)} | {20: 20, 21: 20, 30: 30} | {k: 100 for k in range(100, 161)}
    assert got == want


def test_connected_in_rounds_and_at_once(spark, monkeypatch):
    """Few links are contracted by one task; more go through rounds until they are few.  Both give the same."""
    kept = []
    monkeypatch.setattr(linking, "keep", lambda df, label: kept.append(label) or keep(df, label))
    links = [(k, k + 7) for k in range(0, 400)] + [(1000, k) for k in range(1001, 1200)] + [(5000, 5000)]
    edges = spark.createDataFrame(links, "a long, b long").repartition(7)
    found = []
    for most in (0, 500, linking.LINKS):
        kept.clear()
        found.append({(r.node, r.component) for r in connected(edges, links=most).collect()})
    assert found[0] == found[1] == found[2]
    assert (5000, 5000) in found[0] and {c for _, c in found[0]} == {*range(7), 1000, 5000}
    assert len(kept) == 2  # the links and the stars: no round of shuffles


@pytest.mark.parametrize("chunk", [512, 4])
def test_near_duplicates(spark, monkeypatch, chunk):
    monkeypatch.setattr(linking.linked, "__defaults__", (chunk,))
    base = [f"w{k}" for k in range(120)]
    rows = [(i, " ".join(base[:60] + [f"x{i}"] + base[60:])) for i in range(12)]  # chain of near copies of one text
    rows += [(20 + i, " ".join(base[i * 3:] + [f"e{k}" for k in range(i * 3)])) for i in range(10)]
    rows += [(40, None), (41, " "), (42, "one"), (43, "ONE"), (44, "one two"), (45, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("node", F.lit(1))

    def shingle(t):
        w = (t or "").lower().split()
        return {tuple(w[k:k + 3]) for k in range(max(1, len(w) - 2))} if w else set()

    sets = {i: shingle(t) for i, t in rows}
    group = components(list(sets), lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]))
    got = near_duplicates(docs, size=3, percent=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(s), group[i], group[i] == i) for i, s in sets.items()}


def test_near_duplicates_of_nulls_and_repeats(docs, texts):
    got = near_duplicates(docs, size=3, percent=85).collect()
    assert len(got) == len(texts)
    assert all(r.component_id is None or r.doc_id is None or r.component_id <= r.doc_id for r in got)
    assert {r.component_id for r in got if r.doc_id in (3, 40, 41, 42)} == {3}


@pytest.mark.parametrize("chunk", [512, 3])
def test_lines(spark, monkeypatch, chunk):
    monkeypatch.setattr(linking.linked, "__defaults__", (chunk,))
    line = lambda k: " ".join(f"t{k}_{j}" for j in range(40))
    near = [line(1).replace(f"t1_{j}", f"v{j}") for j in range(12)]
    rows = [(i, "\n".join([line(100 + i), near[i], "", "Common line here", line(5) if i % 2 else line(6).upper()])) for i in range(12)]
    rows += [(50, None), (51, ""), (52, "\n\n"), (53, "common  LINE here"), (None, line(100)), (60, " ".join(line(200 + k) for k in range(50)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("line", F.lit(1))
    keys = sorted({line_key(x) for _, t in rows for x in (t or "").encode().split(b"\n")} - {b""})
    print_of = dict(zip(keys, fingerprints(keys).tolist()))
    group = components(keys, lambda a, b: (print_of[a] ^ print_of[b]).bit_count() <= 3 and similar(a, b, 80))
    first = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for k, x in enumerate((t or "").encode().split(b"\n")):
            if (x := line_key(x)):
                first.setdefault(group[x], (i, k))
    want = {}
    for i, t in rows:
        gone = [k for k, x in enumerate((t or "").encode().split(b"\n")) if line_key(x) and first[group[line_key(x)]] != (i, k)]
        want[i] = (0 if t is None else t.count("\n") + 1, len(gone), gone)
    assert {r.doc_id: (r.n_lines, r.n_removed, r.removed) for r in dedup_report(docs).collect()} == want
    assert len(set(group.values())) < len(keys)  # something is near
    kept = {r.doc_id: r.text for r in drop_lines(docs).collect()}
    assert kept[51] == "" and kept[52] == "\n\n" and 53 not in kept and kept[50] is None
    assert kept[1] == "\n".join(x for k, x in enumerate(rows[1][1].split("\n")) if k not in want[1][2])


def test_null_ids_are_compared(spark):
    """Lines and sets that rows of null ids hold, alone or first, meet near copies like any other."""
    line = lambda k, *new: " ".join([*(f"t{k}_{j}" for j in range(60)), *new])
    for k in (1, 4):
        assert (int(fingerprints([line_key(line(k).encode())])[0]) ^ int(fingerprints([line_key(line(k, "end").encode())])[0])).bit_count() <= 3
    rows = [(1, line(1)), (None, line(1)), (2, line(1, "end")), (None, line(4)), (None, line(4, "end")), (None, "alone")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    lost = sum(r.n_removed for r in dedup_report(docs).collect())
    assert lost == 3  # one of the three lines of group 1 stays, and one of the two of group 4
    some = spark.createDataFrame([(5, line(3)), (None, line(3, "end")), (None, line(7)), (8, line(7, "end"))], "doc_id bigint, text string")
    assert sorted((r.component_id, r.n_shingles, r.kept) for r in near_duplicates(some, size=3, percent=85).collect()) == [
        (5, 58, True), (5, 59, False), (8, 58, False), (8, 59, True)]


def test_edit_distance():
    import random
    rng = random.Random(5)

    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    for _ in range(400):
        a, b = ("".join(rng.choice("abé") for _ in range(rng.randint(0, 9))) for _ in range(2))
        d = slow(a, b)
        for most in range(10):
            assert within(a.encode(), b.encode(), most) == (d <= most), (a, b, most)


def test_windows(docs, texts):
    some = [(i, (t or "").encode().split()) for i, t in texts]
    first = {}
    for i, w in sorted((x for x in some if x[0] is not None), key=lambda x: x[0]):
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k:k + 50]), i)
    want = Counter()
    for i, w in some:
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k:k + 50])] < i:
                gone[k:k + 50] = [True] * 50
        want[i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()] += 1
    assert Counter(tuple(r)[:4] for r in repeated_windows(docs).collect()) == want
    assert sum(k[2] for k in want) > 0 and levels(48, 6) == [6, 12, 24, 48]
    # More levels give the same windows.
    assert sum(r.n_removed for r in repeated_windows(docs, 48, 12).collect()) == sum(r.n_removed for r in repeated_windows(docs, 48, 24).collect())


@pytest.mark.parametrize("most", [4096, 4])
def test_bytes(docs, texts, monkeypatch, most):
    monkeypatch.setattr(bwt, "MOST", most)
    n = Counter()
    raw = [(i, (t or "").encode()) for i, t in texts]
    for _, b in raw:
        n.update(b[k:k + 200] for k in range(len(b) - 199))
    want = Counter()
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if n[b[k:k + 200]] > 1:
                gone[k:k + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[i, len(b), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest()] += 1
    assert Counter(tuple(r)[:5] for r in repeated_bytes(docs).collect()) == want


def test_byte_spans():
    """Repeated strings are passed on as spans, not start by start: two numbers for 135 starts."""
    middle = bytes(range(1, 168)) * 2
    batch = pa.RecordBatch.from_arrays(
        [pa.array([7, 7]), pa.array([0, 0]), pa.array([False, False]), pa.array([1, 2]), pa.array([136, 136], pa.int32()),
         pa.array([b"a" + middle + b"b", b"c" + middle + b"d"])], names=["anchor", "part", "split", "context", "lead", "bytes"])
    out = pa.Table.from_batches(bwt._merge(200)(iter([batch]))).to_pylist()
    assert [(r["context"], r["spans"], r["open"], r["known"]) for r in out] == [(1, [-135, -1], [], []), (2, [-135, -1], [], [])]


def test_byte_cells():
    """Parts of an anchor leave strings open by cells: equal strings are in equal cells, and random ones share none."""
    rng = random.Random(3)
    lefts = [rng.randbytes(106) for _ in range(6)]
    after = bytes(range(230))
    names = ["anchor", "part", "split", "context", "lead", "bytes"]

    def solved(lefts, part):
        n = len(lefts)
        columns = [pa.array([7] * n), pa.array([part] * n), pa.array([True] * n), pa.array(range(n)), pa.array([136] * n, pa.int32())]
        batch = pa.RecordBatch.from_arrays([*columns, pa.array([x + after for x in lefts])], names=names)
        return pa.Table.from_batches(bwt._merge(200)(iter([batch]))).to_pylist()

    a, b = solved(lefts[:3], 0), solved([lefts[0], *lefts[3:]], 1)
    # Strings that start at the 30 bytes all contexts share before the anchor, or at it, are found in the parts.
    assert [r["spans"] for r in a + b] == [[-30, 0]] * 7
    assert all(len(r["open"]) <= 137 // bwt.CELL + 1 and sum(len(o["strings"]) for o in r["open"]) == 106 for r in a + b)
    cells = [{x for r in rows for x in r["cells"]} for rows in (a, b)]
    far = [[(s["start"], s["gram"]) for o in r["open"] if o["cell"] in cells[1] for s in o["strings"]] for r in a]
    # The copied context is looked up whole, others only in the cell where the shared bytes begin.
    assert [len(x) for x in far] == [106] + [(137 - 31) % bwt.CELL] * 2
    assert {s["gram"] for o in b[0]["open"] for s in o["strings"]} == {g for _, g in far[0]}


@pytest.mark.parametrize("block", [1 << 17, 300, 1])
def test_byte_blocks(monkeypatch, block):
    """Texts of one block do not touch: anchors, contexts and removed runs are those of texts on their own."""
    monkeypatch.setattr(bwt, "BLOCK", block)
    texts = [b"", b"x" * 250, bytes(97 + k * k % 26 for k in range(700)), b"", b"short", b"y" * 200, b"z" * 199, b""]
    ids = pa.array(range(len(texts)))
    spots = next(bwt._spots(200)(iter([pa.RecordBatch.from_arrays([ids, pa.array(texts)], names=["doc_id", "text"])]))).to_pydict()
    for t, size, anchors, places in zip(texts, spots["n_bytes"], spots["anchors"], spots["places"]):
        grams = [t[p:p + 64] for p in places]
        assert size == len(t) and len(set(zip(grams, anchors))) == len(set(grams)) == len(set(anchors))
        assert all(any(s <= p <= s + 136 for p in places) for s in range(len(t) - 199)) and (len(t) >= 200) == bool(places)
    wanted = pa.array([[{"place": p, "anchor": a} for p, a in zip(*x)] for x in zip(spots["places"], spots["anchors"])])
    contexts = next(bwt._contexts(200)(iter([pa.RecordBatch.from_arrays([ids, pa.array(texts), wanted], names=["version", "text", "spots"])]))).to_pylist()
    around = {(c["context"], texts[c["version"]][max(0, c["place"] - 136):c["place"] + 200], min(136, c["place"])) for c in contexts}
    assert len(contexts) == sum(map(len, spots["places"]))
    assert len(around) == len({x[0] for x in around}) == len({x[1:] for x in around})  # equal contexts, equal hashes, and the reverse
    hits = [[], [(0, [-136, 0])], [(300, [-20, -10, 5, 5]), (690, [-136, 0])], [], [(0, [-136, 0])], [(100, [-136, 0])], [(60, [-136, 0])], []]
    column = pa.array([[{"place": p, "spans": s} for p, s in h] for h in hits], pa.list_(pa.struct([("place", pa.int32()), ("spans", pa.list_(pa.int32()))])))
    cut = next(bwt._cut(200)(iter([pa.RecordBatch.from_arrays([ids, pa.array(texts), column], names=["version", "text", "hits"])]))).to_pylist()
    for t, h, row in zip(texts, hits, cut):
        gone = bytearray(len(t))
        for p, s in h:
            for a, b in zip(s[::2], s[1::2]):
                for k in range(max(0, p + a), min(len(t) - 200, p + b) + 1):
                    gone[k:k + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(t, gone) if not g)
        assert (row["n_removed"], row["n_spans"], row["kept"]) == (sum(gone), len(re.findall(b"\1+", gone)), kept)
        assert row["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_leftmost_places(monkeypatch):
    rng = random.Random(2)
    for bits in (24, 6):  # with 6 bits, arrays are handled in stretches
        monkeypatch.setattr(windows, "PLACE_BITS", bits)
        for n in (0, 1, 5, 20, 300):
            for width in (1, 2, 3, 7, 20):
                h = [rng.randrange(4) << 40 for _ in range(n)]
                want = [min(range(s, s + width), key=lambda k: (h[k], k)) for s in range(n - width + 1)]
                assert windows.leftmost_places(np.array(h, np.uint64), width).tolist() == want
                assert windows.leftmost_minima(np.array(h, np.uint64), width).tolist() == sorted(set(want))
