"""Operators that judge one row at a time, against plain definitions and on awkward rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from skyloom.llm import gru, html_extract, mixing, mpegts, nb_svm, quality_rules, url_filter
from skyloom.llm.common import slices, span_hashes, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a b c a b c a b c"), (5, "é🙂 漢字"), (6, "x" * 70_000), (None, "the end of the end of the end"), (6, "x" * 70_000), (7, "l1\nl1\n\nl1\r\nl2"), (8, " the and " * 40)]


def frame(spark, rows=ODD):
    """Rows with an extra column whose name clashes with a result's."""
    return spark.createDataFrame([(*r, "s", 9.0, "k") for r in rows], "doc_id long, text string, source string, score double, kept string")


def repeats(ws):
    where = {}
    for i in range(len(ws) - 2):
        where.setdefault(tuple(ws[i : i + 3]), []).append(i)
    return len({i + k for at in where.values() if len(at) > 1 for i in at for k in range(3)})


def test_quality_rules(spark):
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(frame(spark)).collect()}
    for doc_id, text in ODD:
        ws, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
        r = got[doc_id]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(ws), sum(map(len, ws)), len(lines) - len(set(lines)), repeats(ws)), text
        assert r["base_failed"] == (len(ws) < 50 or repeats(ws) * 2 > len(ws)) and not (r["base_failed"] and r["kept"])
    assert quality_rules.quality_rules(frame(spark).limit(0)).count() == 0


def test_mixing_meets_targets_and_repeats(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a", "a", "a", "b", None, "c"])) for k in range(400)] + [(5, "w w", "b"), (5, "w w", "b"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, again = (sorted(map(tuple, mixing.mix(df).collect()), key=str) for _ in range(2))
    assert first == again and len(first) == len(rows)
    by = {}
    for _, source, size, source_size, target, taken in first:
        assert 0 <= taken <= 3 * size
        by.setdefault(source, [target, 0, source_size])[1] += taken
    assert all(abs(t - n) <= 1 and t <= 3 * s + 1e-9 for t, n, s in by.values())
    assert abs(sum(t for t, _, _ in by.values()) - sum(len((t or "").split()) for _, t, _ in rows)) < 1e-6
    cut = mixing.mixed_rows(df)
    words_of = {}
    for r in cut.collect():
        words_of[r["source"]] = words_of.get(r["source"], 0) + len((r["text"] or "").split())
    assert cut.columns == df.columns and all(abs(words_of.get(s, 0) - n) <= 30 for s, (_, n, _) in by.items())  # half of the longest text
    assert {r["text"] for r in cut.collect()} <= {t for _, t, _ in rows}
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixing_by_weight_prefers_heavy_documents(spark):
    rows = [(k, "w " * 10, "a", 3.0 if k % 2 else 1.0) for k in range(200)] + [(1000 + k, "w " * 10, "b", 1.0) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, pref double")
    got = mixing.mix(df, weights=(1, 3), weight_col="pref").collect()
    heavy = sum(r["taken"] for r in got if r["source"] == "a" and r["doc_id"] % 2)
    assert heavy > 1.5 * sum(r["taken"] for r in got if r["source"] == "a" and r["doc_id"] % 2 == 0)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 148, 162, 163, 176, 184, 4095, 4096, 4097, 70_000])
def test_transport_stream_round_trip(n):
    payload = mpegts.padded(random.Random(n).randbytes(n))
    found = mpegts.demux(mpegts.mux(payload))
    assert found.payload() == payload and found.streams == {mpegts.DATA_PID: mpegts.PRIVATE_DATA} and found.discontinuities == found.bad_sections == 0
    assert [u[1] for u in found.units] == [k * mpegts.TICKS for k in range(len(found.units))] and found.units[0][2]


def test_transport_stream_errors():
    data = bytearray(mpegts.mux(b"a" * 9000))
    lost = bytes(data[: 4 * 188] + data[5 * 188 :])
    assert mpegts.demux(lost).discontinuities == 1
    data[20] ^= 1
    assert mpegts.demux(bytes(data)).bad_sections == 1
    with pytest.raises(ValueError):
        mpegts.demux(b"x" * 188)


def test_tables_over_several_packets_and_legal_repeats():
    stream = mpegts.mux(b"b" * 9000)
    # a map table of 60 streams needs two packets; the first stream is the data's
    entries = b"".join(bytes([6]) + (0xE000 | mpegts.DATA_PID + k).to_bytes(2, "big") + b"\xf0\x00" for k in range(60))
    body = bytes([2, 0xB0 | (13 + len(entries)) >> 8, (13 + len(entries)) & 255, 0, 1, 0xC1, 0, 0]) + (0xE000 | mpegts.DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + entries
    section = b"\0" + body + mpegts.crc32_mpeg(body).to_bytes(4, "big")
    head = lambda start, count: bytes([0x47, start | 0x10, 0, 0x10 | count])
    table = head(0x40, 0) + section[:184] + (head(0, 1) + section[184:]).ljust(188, b"\xff")
    found = mpegts.demux(stream[:188] + table + stream[376:])
    assert len(found.streams) == 60 and found.payload() == b"b" * 9000 and found.bad_sections == found.discontinuities == 0
    twice = stream[: 188 * 6] + stream[188 * 5 : 188 * 6] + stream[188 * 6 :]
    assert (mpegts.demux(twice).discontinuities, mpegts.demux(twice).payload()) == (0, b"b" * 9000)
    assert mpegts.demux(stream[: 188 * 6] + stream[188 * 5 : 188 * 6] * 2 + stream[188 * 6 :]).discontinuities == 1
    start = next(k for k in range(3, 60) if stream[188 * k + 1] & 0x40)  # the second unit's first packet has an adaptation field
    jump = bytearray(stream[: 188 * (start - 2)] + stream[188 * start :])
    assert mpegts.demux(bytes(jump)).discontinuities == 1
    jump[188 * (start - 2) + 5] |= 0x80
    assert mpegts.demux(bytes(jump)).discontinuities == 0


def test_unit_table(spark):
    texts = {1: "x" * 40_000, 2: "", 3: None}
    media = mpegts.media_table(frame(spark, list(texts.items())))
    rows = mpegts.unit_table(media).collect()
    streams = {r["doc_id"]: r["media"] for r in media.collect()}
    assert mpegts.media_columns(frame(spark, [(1, texts[1])])).first()["media_sha256"] == hashlib.sha256(streams[1]).hexdigest()
    for d, text in texts.items():
        own = sorted((r for r in rows if r["doc_id"] == d), key=lambda r: r["unit"])
        n = len(mpegts.padded((text or "").encode()))
        assert [r["pts"] for r in own] == [k * mpegts.TICKS for k in range(len(own))] and sum(r["n_bytes"] for r in own) == n
        assert [r["random_access"] for r in own] == [k % mpegts.KEY_EVERY == 0 for k in range(len(own))]
        assert all(streams[d][r["media_offset"]] == 0x47 and streams[d][r["media_offset"] + 1] & 0x40 for r in own)
        assert len(streams[d]) == mpegts.media_columns(frame(spark, [(d, text)])).first()["media_bytes"]
        first = own[-1]["media_offset"]  # a stream can be read from a unit on, after its tables
        assert len(mpegts.demux(streams[d][:376] + streams[d][first:]).payload()) == own[-1]["n_bytes"]


def test_media_columns(spark):
    rows = mpegts.media_columns(frame(spark)).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        texts = {t for d, t in ODD if d == r["doc_id"]}
        data = (texts.pop() or "").encode()
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_url_rules_and_classifier(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.com/en/7x?q#f", "https://a.b.com/en/1", "http://com/en/", "http://xcom/en/", "ftp://m.example.net/de/8", "https://q.net/de/8", "https://www.org/es/", "http://casinopoker.example.org/fr/1", "http://weather.example.org", "a://b://c/en/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'x' AS host", "1 AS verdict")
    got = {r["page_id"]: r for r in url_filter.url_filter(df).collect()}
    assert [got[k]["rule"] for k in range(13)] == [None, None, None, "example.com/en/7", "com/en/", "com/en/", None, "example.net/de/8", "net/de/", "org/es/", None, None, None]
    assert [got[k]["verdict"] for k in (0, 3, 4, 7, 8, 9, 10, 11)] == ["allow", "allow", "block", "block", "allow", "block", "block", "allow"]
    assert (got[3]["host"], got[3]["path"], got[12]["host"], got[12]["path"]) == ("example.com", "/en/7x", "b:", "//c/en/")
    assert url_filter.url_filter(df.limit(0)).count() == 0


def test_segmentation():
    known = {"cheap": 0.01, "pills": 0.01, "che": 0.001, "win": 0.01}
    assert url_filter.segment("cheappills", known) == ["cheap", "pills"] and url_filter.segment("", known) == []
    assert url_filter.segment("window", known) == ["window"] and url_filter.segment("darwin", known) == ["darwin"]


def test_segmentation_equals_brute_force():
    rng = random.Random(7)
    for _ in range(200):
        known = {"".join(rng.choices("ab", k=rng.randint(1, 4))): rng.random() / 100 for _ in range(5)}
        name = "".join(rng.choices("abc", k=rng.randint(1, 9)))

        def value(ws):
            return sum(np.log(known[w]) if w in known else np.log(url_filter.UNKNOWN) - len(w) * np.log(4) for w in ws)

        splits = [[name[i:j] for i, j in zip([0, *at], [*at, len(name)], strict=True)] for m in range(len(name)) for at in itertools.combinations(range(1, len(name)), m)]
        assert abs(value(url_filter.segment(name, known)) - max(map(value, splits))) < 1e-9


def slow_url_filter(rows):
    """Scores of (url, html) rows, all in plain Python."""
    low, letters = str.lower, re.compile(r"[^\W\d_]+")
    seeds = [Counter(w for s in x for w in s.split()) for x in (url_filter.BLOCK_SEEDS, url_filter.ALLOW_SEEDS)]
    parsed = []
    for url, _ in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (low(m[1]), m[2]) if m else ("", "")
        fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        parsed.append((host, path, max(fits, key=lambda r: len(str(r)), default=None)))
    n = Counter(w for _, path, _ in parsed for w in letters.findall(low(path))) + Counter(w for _, h in rows for w in letters.findall(low(re.sub("<[^>]*>", " ", h or ""))))
    every = seeds[0] + seeds[1]
    known = {w: 0.5 * n[w] / n.total() + 0.5 * every[w] / every.total() for w in {*n, *every}}
    split = lambda x: [w for r in letters.findall(low(x)) for w in url_filter.segment(r, known)]
    uses = [Counter(), Counter()]
    for host, path, rule in parsed:
        if rule:
            uses[rule.verdict == "allow"].update(split(host[: len(host) - len(rule.host)]) + split(path[len(rule.path) :]))
    theta = lambda k, w: 0.5 * uses[k][w] / uses[k].total() + 0.5 * seeds[k][w] / seeds[k].total()
    smooth = lambda k, w: 0.9 * theta(k, w) + 0.05 * (theta(0, w) + theta(1, w))
    out = []
    for host, path, _ in parsed:
        owner = host.rsplit(".", 1)[0] if "." in host and host.rsplit(".", 1)[0] else host
        ws = split(owner) + split(path)
        out.append(np.log(0.25) + sum(np.log(smooth(0, w) / smooth(1, w)) for w in ws if theta(0, w) + theta(1, w)))
    return out


def test_url_classifier_learns_from_the_rules_and_equals_brute_force(spark):
    rng = random.Random(3)
    bad, good, words_ = ["grabby", "loot", "shady"], ["calm", "tidy", "honest"], ["river", "stone", "cloud", "paper", "Été"]
    rows = []
    for k in range(300):
        kind = k % 3  # two labelled by rules, one not
        name = "".join(rng.choices(bad if k % 2 else good, k=2) + rng.choices(words_, k=1)).lower()
        where = ("com/en/" if k % 2 else "net/de/") if kind else f"{rng.choice(['com', 'net', 'org'])}/fr/"
        rows.append((f"http://www.{name}.{where}{rng.choice(words_)}{k}", "<p class=x>" + " ".join(rng.choices(bad + good + words_, k=20)) + "</p>"))
    rows += [(None, None), ("http://x" + "loot" * 900 + ".org/fr", "<b>loot"), rows[0]]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, html string").selectExpr("*", "1 AS label")
    got = {r["page_id"]: r for r in url_filter.url_filter(df).collect()}
    want = slow_url_filter(rows)
    assert len(got) == len(rows) and all(abs(got[k]["score"] - x) < 1e-6 for k, x in enumerate(want))
    free = [(k % 2 == 1, got[k]["verdict"] == "block") for k in range(300) if k % 3 == 0]  # names that no list has
    assert sum(a == b for a, b in free) / len(free) > 0.95


def test_html_extraction(spark):
    page = """<html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a>one</a></li></ul></nav><div class="cookie-notice">ok?</div>
    <article><h1>Head &amp;  line</h1><p>A first   paragraph with <b>bold</b> text<br>and more of it.</p><p>No.</p></article><aside>side</aside><section id="comments"><p>reader text</p></section><form><p>x</p></form><footer>&copy; f</footer>"""
    assert html_extract.extract(page) == "Head & line\nA first paragraph with bold text and more of it.\nNo."
    assert html_extract.extract("") == html_extract.extract("<nav>x</nav>") == "" and html_extract.extract("plain words only") == "plain words only"
    rows = [(1, "u", page), (2, None, None), (1, "u", page), (3, "u", "<article><p>" + "word " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text")
    got = html_extract.extract_pages(df).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 64, 64, 249_999] and html_extract.extract_pages(df.limit(0)).count() == 0


def test_html_extraction_keeps_the_whole_article():
    long, links = "<p>" + "A paragraph of some length. " * 20 + "</p>", "<div>" + "<a>x</a> <a>y</a>" * 5 + "</div>"
    cells = "".join(f"<tr><td>k{k}</td><td>v{k}</td></tr>" for k in range(8))
    pairs = "".join(f"<div><b>name {k}</b>: {k}</div>" for k in range(6))
    inner = f"{long}<table>{cells}</table><section><h2>Notes</h2>" + "<p>Short.</p>" * 5 + f'</section>{pairs}<div class="share"><p>tweet</p></div>'
    want = [x for k in range(8) for x in (f"k{k}", f"v{k}")] + ["Notes"] + ["Short."] * 5 + [f"name {k}: {k}" for k in range(6)]
    for page in (f"<body>{links}<article>{inner}</article>{links * 3}</body>", f"<body>{links}<main><div>{inner}</div></main>{links * 3}</body>", f"<body><div>{inner}</div></body>"):
        assert html_extract.extract(page).split("\n")[1:] == want
    assert html_extract.extract(f"<body>{long}<table>{cells}</table></body>").split("\n")[1:] == want[:16]


def test_ratio_decides_both_ways():
    long = "<p>" + "A paragraph of some length. " * 12 + "</p>"
    links = "".join(f"<div><a href=x>Link number {k}</a> <a>and</a> <a>more</a></div>" for k in range(8))
    short, junk = "<p>No.</p>", "<p>Imprint 2020.</p>"
    # the short line stands amid paragraphs, a longer one amid links
    page = f"<body>{links}{junk}{links}{long}{short}{long}{links}</body>"
    text = html_extract.extract(page)
    assert "No." in text and "Imprint" not in text and "Link" not in text
    # lines and cut as defined, by a slow convolution
    lines = html_extract.Lines()
    lines.feed(page)
    found = lines.finish()
    ratio = [(len(t) - k) / n for t, n, k, *_ in found]
    w = [np.exp(-0.5 * d * d) for d in range(-3, 4)]
    slow = []
    for k in range(len(ratio)):
        near = [(w[d + 3], ratio[k + d]) for d in range(-3, 4) if 0 <= k + d < len(ratio)]
        slow.append(sum(a * b for a, b in near) / sum(a for a, _ in near))
    assert np.allclose(html_extract.smooth(np.array(ratio)), slow)
    x = np.log1p(slow)
    cut = min((sum(((g - g.mean()) ** 2).sum() for g in (x[x < c], x[x >= c]) if len(g)), c) for c in sorted(x)[1:])[1]
    assert (np.array(slow) >= html_extract.level(np.array(slow))).tolist() == (x >= cut).tolist()
    assert text.split("\n") == [t for t, s in zip([f[0] for f in found], x >= cut, strict=True) if s and t and "Link" not in t]


def test_wrappers_and_implied_ends():
    long = "Real text that goes on for a while, with several words in it."
    assert html_extract.extract(f'<div class="page has-sidebar"><p>{long}</div>') == long
    assert html_extract.extract(f'<div class="header-fixed layout"><p>{long}</div>') == long
    assert html_extract.extract(f"<body><form><nav>x</nav><div><p>{long}</p><p>{long}</p></div></form></body>") == f"{long}\n{long}"
    assert html_extract.extract(f'<div><p class="notice">x<p>{long}</div>') == long
    assert html_extract.extract(f'<ul><li class="menu">a<li>{long}</ul>') == long
    assert html_extract.extract(f"<dl><dt class=ad>a<dd>{long}<table><tr class=ad><td>b<tr><td>c</table></dl>") == f"{long}\nc"
    assert html_extract.extract(f"<article><header><h1>Head</h1></header><p>{long}</article>") == f"Head\n{long}"
    assert html_extract.extract(f"<article><p>{long}</article><section id=comments><p>{long * 9}</section>") == long
    assert html_extract.extract('<div class="cookie-notice">ok?</div>') == html_extract.extract("<footer><p>x</footer>") == ""


def test_slices_and_hashes():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["ab  ab", None, "", "x" * 100, "ab"])})
    seen = []
    for part, data, at in slices(batch, "text", 8):
        start, end, counts = words(data, at)
        seen += list(zip(np.repeat(np.arange(part.num_rows), counts).tolist(), span_hashes(data, start, end).tolist(), strict=True))
    assert len(seen) == 4 and seen[0][1] == seen[1][1] == seen[3][1] != seen[2][1]


def labelled(spark, bad, n=300):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(300)]
    rows = []
    for k in range(n):
        ws = rng.choices(vocabulary, k=rng.randint(20, 120))
        if k % 3 == 0:
            bad(ws, rng)
        rows.append((k, " ".join(ws), int(k % 3 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(9000, None), (9001, ""), (None, "a b")], "doc_id long, text string").selectExpr("*", "'c' AS score")
    return docs, spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (1, None)], "doc_id long, label int"), dict((r[0], r[2]) for r in rows)


def accuracy(rows, truth):
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert all(0 <= r["score"] <= 1 for r in rows) and all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) == r["held_out"] for r in rows if r["doc_id"] is not None)
    return sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held)


def test_nb_svm_held_out(spark):
    def shout(ws, rng):
        ws[:] = [w.upper() + "!!" for w in ws]

    docs, labels, truth = labelled(spark, shout)
    model = nb_svm.fit_quality(docs, labels, "label", {0: 200, 1: 200})
    rows = nb_svm.score(docs, model).collect()
    assert len(rows) == 303 and accuracy(rows, truth) > 0.95
    assert nb_svm.score(docs.limit(0), model).count() == 0
    assert {r["score"] for r in nb_svm.score(docs, nb_svm.fit_quality(docs, labels.limit(0), "label")).collect()} == {0.5}


def test_nb_svm_scores_equal_brute_force():
    rng = random.Random(2)
    texts = [" ".join(rng.choices("aa bb cc DD e1 !! ... zz".split(), k=rng.randint(0, 30))).encode() for _ in range(60)]
    y = np.array([t.count(b"zz") > 2 for t in texts], np.int64)
    rows = []
    for t in texts:
        rows.append(nb_svm.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[1])
    model = nb_svm.fit(rows, y)
    data, at = gru._join(texts)
    row, f = nb_svm.features(data, at)
    assert all(np.array_equal(f[row == k], r) for k, r in enumerate(rows))
    n = [np.zeros(1 << nb_svm.BITS), np.zeros(1 << nb_svm.BITS)]
    learned = [k for k in range(60) if k % 5 != 4]
    for k in learned:
        n[y[k]][rows[k]] += 1
    seen = (n[0] + n[1]) > 0
    ratio = {int(i): np.log((n[1][i] + 1) / (n[1] + 1)[seen].sum()) - np.log((n[0][i] + 1) / (n[0] + 1)[seen].sum()) for i in np.flatnonzero(seen)}
    for k, r in enumerate(rows):
        own = [int(i) for i in r if int(i) in ratio]
        length = max(1e-9, np.sqrt(sum(ratio[i] ** 2 for i in own)))
        margin = sum(float(model.weights[i]) for i in own) / length + model.bias
        assert abs(model.scores(data, at)[k] - 1 / (1 + np.exp(-(model.slope * margin + model.shift)))) < 1e-5


def test_dual_coordinate_descent_closes_the_gap():
    rng = np.random.default_rng(4)
    rows = [np.sort(rng.choice(30, 6, replace=False)) for _ in range(40)]
    values = [rng.normal(size=6) for _ in rows]
    y, cost = rng.integers(0, 2, 40), np.full(40, 0.7)
    w, b = nb_svm.dual_coordinate_descent(rows, values, y, cost, 30, epochs=4000)
    x = np.zeros((40, 31))
    for k, (r, v) in enumerate(zip(rows, values, strict=True)):
        x[k, r] = v
    x[:, 30] = 1  # the bias is a feature of every row
    sign, full = np.where(y == 1, 1.0, -1.0), np.append(w, b)
    loss = lambda z: z @ z / 2 + (cost * np.maximum(0, 1 - sign * (x @ z))).sum()
    here = loss(full)
    assert all(loss(full + rng.normal(size=31) * s) > here - 1e-6 for s in (1e-3, 1e-2, 0.1) for _ in range(200))


def test_gru_scores_equal_brute_force():
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choices("abcdé", k=rng.randint(1, 5))) for _ in range(n)).encode() for n in (0, 1, 5, 31, 32, 33, 70, 200)]
    data, at = gru._join(texts)
    net = gru.Network(np.sort(np.unique(gru.read_words(data, at).hashes)[::2]))
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    sig = lambda x: 1 / (1 + np.exp(-x))
    want = []
    for t in texts:
        w = gru.read_words(*gru._join([t]))
        vectors = []
        for i in w.index:
            k = np.searchsorted(net.vocabulary, w.hashes[i])
            known = k < len(net.vocabulary) and net.vocabulary[k] == w.hashes[i]
            vectors.append(np.concatenate([p["word"][k + 1 if known else 0], p["char"][w.trigrams[w.begin[i] : w.begin[i + 1]]].mean(axis=0)]))
        n = max(1, -(-max(len(vectors) - gru.WINDOW, 0) // gru.STRIDE) + 1)
        scores = []
        for k in range(n):
            xs = vectors[k * gru.STRIDE : k * gru.STRIDE + gru.WINDOW]
            sides = []
            for side, seq in (("f", xs), ("b", xs[::-1])):
                h, out = np.zeros(gru.HIDDEN), []
                for x in seq:
                    a, u = x @ p[f"w{side}"] + p[f"b{side}"], h @ p[f"u{side}"]
                    z, r = np.split(sig(a[: 2 * gru.HIDDEN] + u[: 2 * gru.HIDDEN]), 2)
                    h = h + z * (np.tanh(a[2 * gru.HIDDEN :] + r * u[2 * gru.HIDDEN :]) - h)
                    out.append(h)
                sides.append(out if side == "f" else out[::-1])
            states = np.array([np.concatenate(s) for s in zip(*sides, strict=True)]).reshape(-1, 2 * gru.HIDDEN)
            if not len(states):
                scores.append(float(p["bo"][0]))
                continue
            e = np.tanh(states @ p["wa"] + p["ba"]) @ p["va"]
            e = np.exp(e - e.max())
            scores.append(float((e / e.sum()) @ states @ p["wo"] + p["bo"][0]))
        want.append(max(scores))
    assert np.allclose(net.logits(data, at), want, atol=1e-3)


def test_gru_held_out(spark):
    def insult(ws, rng):
        for _ in range(3):
            ws.insert(rng.randrange(len(ws)), rng.choice(["zzot", "kwyx"]))

    docs, labels, truth = labelled(spark, insult)
    model = gru.fit_toxicity(docs, labels, "label", {0: 200, 1: 200})
    rows = gru.score(docs, model).collect()
    assert len(rows) == 303 and accuracy(rows, truth) > 0.9
    assert gru.score(docs.limit(0), model).count() == 0
    kept = gru.score(docs.drop("score"), model, keep=("text",))
    assert sorted((r["text"] or "", r["score"]) for r in kept.collect()) == sorted((dict((d["doc_id"], d["text"]) for d in docs.collect())[r["doc_id"]] or "", r["score"]) for r in rows)
    assert {r["score"] for r in gru.score(docs, gru.Model(None)).collect()} == {0.0}


def test_gru_gradients():
    net = gru.Network(np.sort(span_hashes(*[np.frombuffer(b"aabb", np.uint8), np.array([0, 2]), np.array([2, 4])])))
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    data, at = gru._join([b"aa cc bb aa dd", b"bb ee"])
    w = gru.read_words(data, at)
    place, _ = gru.windows(w.counts, len(w.index))
    d = np.array([0.7, -0.4])

    def loss():
        return float(net.forward(net.inputs(w), w.index, place) @ d)

    _, saved = net.forward(net.inputs(w), w.index, place, keep=True)
    grads = net.gradients(net.inputs(w).astype(np.float64), w, saved, d)
    rng = np.random.default_rng(0)
    for k, g in grads.items():
        flat = np.flatnonzero(np.abs(g.ravel()) > 1e-6)
        for i in rng.choice(flat, min(3, len(flat)), replace=False):
            at_ = np.unravel_index(i, g.shape)
            keep = net.p[k][at_]
            net.p[k][at_] = keep + 1e-3
            up = loss()
            net.p[k][at_] = keep - 1e-3
            down = loss()
            net.p[k][at_] = keep
            assert abs((up - down) / 2e-3 - g[at_]) < 2e-2 * max(1.0, abs(g[at_])), (k, at_)


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 48, 49, 500):
        place, row = gru.windows(np.array([n]), n)
        assert set(place.ravel()) - {n} == set(range(n)) and len(row) >= 1
