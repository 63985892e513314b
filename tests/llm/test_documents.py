import base64
import hashlib

from larkspur.llm.chat import collapsed, positioned, rendered
from larkspur.llm.common import new_path
from larkspur.llm.extract import main_text
from larkspur.llm.importance import kth_largest, labelled, resampled
from larkspur.llm.latent import common_length, leaks, _masks
from larkspur.llm.warc import archived, original_records, read_archive, write_archive


def test_warc_round_trip(spark):
    rows = [(1, "http://a/1", "<p>x</p>", "e"), (2, None, "<p>x</p>", "e"), (3, "http://a/3", None, "e"), (4, "http://a/4", "", "e"), (9, "http://a/1", "<p>x</p>", "e"), (9, "http://a/1", "<p>x</p>", "e"), (None, "http://n", "null id", "e"), (5, "u\r\nX: y", "é" * 500_000, "e")]
    path = new_path(spark, "warc")
    write_archive(spark.createDataFrame(rows, "page_id long, url string, html string, header string"), path)
    got = read_archive(spark, path)
    best = {}
    for p, _, h, _ in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if p is None else p)
    want = []
    for p, _, h, _ in rows:
        b = (h or "").encode()
        ref = best[h or ""]
        first = ref in (-1, p)
        want.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first else "revisit", None if first else ref))
    assert sorted(map(repr, (tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got.collect()))) == sorted(map(repr, want))
    assert spark.read.parquet(f"{path}/payloads").count() == len(best)
    # what the records' own bytes say
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, header string")
    assert sorted(map(repr, map(tuple, archived(frame).collect()))) == sorted(map(repr, want))
    whole = [(r["page_id"], bytes(r["record"])) for r in original_records(spark, path).collect()]
    name = lambda r: r.split(b"WARC-Record-ID: ")[1].split(b"\r\n")[0]
    assert len({name(r) for _, r in whole}) == len(rows)
    assert {r.split(b"WARC-Refers-To: ")[1].split(b"\r\n")[0] for p, r in whole if p in (1, 2)} <= {name(r) for p, r in whole if p == 9}
    record = dict(whole)
    assert b"WARC-Target-URI: u%0D%0AX:%20y\r\n" in record[5]
    head, _, body = record[5].partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response") and body.endswith("é".encode() * 500_000 + b"\r\n\r\n")
    assert f"Content-Length: {len(body) - 4}".encode() in head
    empty = new_path(spark, "warc")
    write_archive(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert read_archive(spark, empty).collect() == []


def test_chat_collapse(spark):
    base = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "end")]
    rows = [(c, t, *base[t]) for c, n in ((1, 2), (2, 4), (3, 4), (4, 1)) for t in range(n)]
    rows += [(5, 0, "user", "hi"), (5, 1, "assistant", None), (6, 7, None, "odd turn"), (6, 7, None, "odd turn"), (None, 0, "user", "hi"), (8, None, "user", "hi")]
    rows += [(9, t, "user", f"t{t}") for t in range(700)] + [(10, 0, "user", "far"), (10, 3_000_000_000, "user", "apart " * 100_000)]
    schema = "conv_id long, turn long, role string, text string"
    turns = spark.createDataFrame(rows, schema).selectExpr("*", "'x' as pos")
    state = {r["conv_id"]: (r["n_turns"], r["copies"], r["kept"]) for r in collapsed(positioned(turns)).collect()}
    assert state == {1: (2, 1, False), 2: (4, 2, True), 3: (4, 2, False), 4: (1, 1, False), 5: (2, 1, True), 6: (1, 1, True), 9: (700, 1, True), 10: (2, 1, True)}
    text = {}
    for r in rendered(turns).orderBy("conv_id", "part").collect():
        text[r["conv_id"]] = text.get(r["conv_id"], "") + r["text"]
    assert text[2] == "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in base)
    assert text[9] == "".join(f"<|im_start|>user\nt{t}<|im_end|>\n" for t in range(700)) and sorted(text) == [2, 5, 6, 9, 10]
    # a conversation with gaps is one part, and a long one has parts of equal numbers of turns
    parts = [(r["conv_id"], r["part"], r["n_turns"]) for r in rendered(turns).orderBy("conv_id", "part").collect() if r["conv_id"] >= 9]
    assert parts == [(9, 0, 256), (9, 1, 256), (9, 2, 188), (10, 0, 2)]
    assert rendered(spark.createDataFrame([], schema)).collect() == []


PAGE = """<html><head><title>t</title><script>var a = "</p><p>no</p>";</script></head><body class="home"><nav><p>menu</p></nav><header>top</header>
<div class="cookie-notice">we use</div><article><h1>Head &amp; line</h1><div class="site-box"><p>Follow us</p></div><p><b>One  two<br>three<!-- no --><p>Four &eacute;&nbsp;five
<ul><li>a<li>b</ul><div class="ad">buy</div><form><p>mail</p></form><section id="comments"><article><p>first!</p></article></section>
<p>%s</p></article><aside>side</aside><footer>&copy; x</footer></body></html>"""


def test_html_extraction(spark):
    rows = [(i, f"https://a.example/{i}", PAGE % f"own {i}") for i in range(12)]
    rows += [(20, "https://b.example/", "<body><p>plain</p>tail<div>x &lt; y</div>"), (21, None, None), (22, "u", ""), (23, "https://b.example/", "<p>no end <i>it</i>alic"), (3, rows[3][1], rows[3][2])]
    got = main_text(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as host"))
    text = {r["page_id"]: r["text"] for r in got.collect()}
    # what every article of the host has, as a heading or a box, stays in it
    assert all(text[i] == f"Head & line\nFollow us\nOne two three\nFour é five\na\nb\nown {i}" for i in range(12))
    assert text[20] == "plain\ntail\nx < y" and text[21] == text[22] == "" and text[23] == "no end italic"
    alone = main_text(spark.createDataFrame(rows[:3], "page_id long, url string, html string")).where("page_id = 1").first()
    assert alone["text"] == "Head & line\nFollow us\nOne two three\nFour é five\na\nb\nown 1" and alone["n_chars"] == len(alone["text"])
    assert got.count() == len(rows)
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_html_reposts_keep_their_text(spark):
    article = "<h1>The mill on the river</h1>" + "".join(f"<p>Paragraph {i} tells at some length what happened at the old mill.</p>" for i in range(5))
    page = "<html><head><title>t%s</title></head><body><nav>n%s</nav><article>%s</article><div class='ad'>buy %s</div></body></html>"
    again = [page % (i, i, article, i) for i in range(14)]
    titled = [page % (i, i, article.replace("The mill on the river", f"Edition {i}"), i) for i in range(14)]
    plain = [f"<body><div>promoted {i}</div>{article}</body>" for i in range(14)]
    other = [page % (i, i, f"<p>Follow us everywhere</p><p>Something else on day {i} that only this page says.</p>", i) for i in range(12)]
    rows = [(100 * k + i, f"https://{'abc'[k]}.example/{i}", h) for k, pages in enumerate((again, titled, plain)) for i, h in enumerate(pages)]
    rows += [(1000 + i, f"https://a.example/o{i}", h) for i, h in enumerate(other)]
    text = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    body = "\n".join(f"Paragraph {i} tells at some length what happened at the old mill." for i in range(5))
    for i in range(14):
        assert text[i] == f"The mill on the river\n{body}" and text[100 + i] == f"Edition {i}\n{body}" and text[200 + i] == f"promoted {i}\nThe mill on the river\n{body}"
    assert all(text[1000 + i] == f"Follow us everywhere\nSomething else on day {i} that only this page says." for i in range(12))


def test_leaks(spark):
    item = "which small river runs past the old mill and then turns to the north the answer is the river lynd"
    filler = " ".join(f"w{i}" for i in range(150))
    para = item.replace("small", "little").replace("old mill", "mill house")
    docs = [(1, f"{filler} {item}, {filler}", "x"), (2, filler, "x"), (3, f"{filler}. {para} {filler}", "x"), (4, None, "x"), (5, "", "x"), (6, item.upper(), "x"), (7, "the river and the mill " * 40, "x"), (1, f"{filler} {item}, {filler}", "x")]
    docs += [(8, f"{filler[:90]} a six word item is QUOTED here, {filler}", "x"), (9, "six word a item is quoted", "x"), (8, "another text", "x"), (20, f"{filler} " * 2000 + item, "x")]
    items = [(10, item), (11, " ".join(f"q{i}" for i in range(30))), (12, None), (13, "a six-word item is quoted"), (13, "a six-word item is quoted"), (14, "..."), (15, "another text")]
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == [(1, 10), (3, 10), (6, 10), (8, 13), (8, 15), (20, 10)]
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert leaks(nothing, spark.createDataFrame(items, "item_id long, text string")).collect() == []
    assert leaks(spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame([], "item_id long, text string")).collect() == []


def test_leaks_that_are_frequent(spark):
    import random

    rng = random.Random(5)
    item = "which small river runs past the old mill and then turns to the north the answer is the river lynd"
    plain = "this is what we have and that is what they have so it is all the same to us"
    word = lambda: f"w{rng.randrange(3000)}"
    docs = []
    for i in range(600):
        text = [word() for _ in range(60)]
        if i % 3 == 0:  # in short texts of its own, at any place
            text = text[: rng.randrange(20)] + item.split() + text[:9]
        if i % 10:  # words of the second item are everywhere, in any order
            text += rng.sample(plain.split(), 18)
        docs.append((i, " ".join(text)))
    docs += [(900, f"{word()} {plain} {word()}"), (901, f"{word()} {item.replace('small', 'little').replace('old mill', 'mill house')} {word()}")]
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item), (2, plain)], "item_id long, text string")).collect()
    assert {r["doc_id"] for r in got if r["item_id"] == 1} == {*range(0, 600, 3), 901}
    assert 900 in {r["doc_id"] for r in got if r["item_id"] == 2}


def test_paraphrases_of_common_words(spark):
    import random

    # items of words that are each in more than a twentieth of the passages, told again with four of 24 words changed
    rng = random.Random(11)
    common = [f"c{k}" for k in range(80)]
    items = [[rng.choice(common) for _ in range(24)] for _ in range(40)]
    docs = [(i, " ".join(rng.choice(common) for _ in range(rng.randint(60, 200)))) for i in range(400)]
    for k, words in enumerate(items):
        told = [f"x{k}y{i}" if i % 6 == 5 else w for i, w in enumerate(words)]
        docs.append((1000 + k, " ".join([rng.choice(common) for _ in range(40)] + told + [rng.choice(common) for _ in range(40)])))
    got = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in got}
    assert len({k for k in range(40) if (1000 + k, k) in pairs}) >= 36
    assert len({d for d, _ in pairs if d < 1000}) == 0


def test_leaks_against_brute_force(spark):
    import random
    import re

    rng = random.Random(8)
    words = [f"v{i}" for i in range(1500)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(15, 40)))) for k in range(25)]
    docs = []
    for i in range(240):
        text = rng.choices(words, k=rng.randint(30, 200))
        if i % 3 == 0:
            own = rng.choice(items)[1].split()
            for _ in range(rng.choice((0, 2, 4, 9))):
                own[rng.randrange(len(own))] = rng.choice(words)
            text[rng.randrange(len(text)) :] = own
        docs.append((i, " ".join(text)))
    want = set()
    for d, text in docs:
        said = re.findall(r"\w+", text)
        for k, item in items:
            own = item.split()
            n, masks, ending = len(own), _masks(own), _masks(own[-6:])
            for a in range(0, len(said), 4):
                window = said[a : a + n + 8]
                share = common_length(masks, n, window) / n
                if share >= 0.75 or share >= 0.6 and common_length(ending, 6, window) >= 0.6 * 6:
                    want.add((d, k))
    got = {(r["doc_id"], r["item_id"]) for r in leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= want and len(got) >= 0.97 * len(want) > 30


def test_common_length():
    a, b = [1, 2, 3, 4, 2, 9], [2, 3, 7, 2, 9, 1]
    assert common_length(_masks(a), len(a), b) == 4


def labelled_corpus():
    import random

    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(1500):
        bad = i % 8 == 0
        text = rng.choices(words, k=rng.randint(20, 80))
        if bad:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["filth", "slurry", "muckle"]))
        elif i % 3 == 0:
            text.append("fine")
        docs.append((i, " ".join(text), "x"))
        if i % 2 == 0 or i > 750:
            labels.append((i, 1, int(bad)))
    docs += [(9000, None, "x"), (9001, "", "x"), (0, docs[0][1], "x"), (8, "fine w1 w2", "x"), (9002, "w1 " * 300_000 + "slurry", "x")]
    return docs, labels + [(None, 1, 0), (2, None, 0)]


DOCS, MARKS = "doc_id long, text string, good string", "doc_id long, quality int, toxic int"


def test_importance_held_out(spark):
    docs, labels = labelled_corpus()
    marks = spark.createDataFrame(labels, MARKS)
    rows = resampled(spark.createDataFrame(docs, DOCS), marks).collect()
    got = {r["doc_id"]: r["kept"] for r in rows if r["doc_id"] != 8}
    assert sum(got[i] for i in range(1500) if i % 8) >= 1290 and sum(got[i] for i in range(0, 1500, 8) if i != 8) <= 25
    assert got[9000] and got[9001] and len(rows) == len(docs)
    assert [r["log_weight"] < 0 for r in rows if r["doc_id"] == 9002] == [True]
    # two texts of one doc_id are weighed apart, equal rows alike
    assert {r["log_weight"] < 0 for r in rows if r["doc_id"] == 8} == {True, False}
    assert len({(r["log_weight"], r["key"]) for r in rows if r["doc_id"] == 0}) == 1
    assert all(r["kept"] for r in resampled(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], MARKS)).collect())
    assert resampled(spark.createDataFrame([], DOCS), marks).collect() == []
    assert labelled(marks, 10).count() == 10


def test_importance_against_brute_force(spark):
    import math
    import re
    from collections import Counter

    from larkspur.llm.importance import with_shares
    from pyspark.sql import functions as F

    docs, labels = labelled_corpus()
    frame, marks = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, MARKS)
    known = {r["doc_id"]: r for r in with_shares(frame.select("doc_id", "text"), labelled(marks, 50_000)).collect()}

    def grams(text):
        tokens = re.findall(r"[0-9A-Za-z]+|[^0-9A-Za-z\s]+", text or "")
        tokens = [("again",) if k and t == tokens[k - 1] else t for k, t in enumerate(tokens)]
        return {*tokens, *zip(tokens, tokens[1:])}

    raw, seen, single, target = Counter(), Counter(), Counter(), Counter()
    totals = [len(docs), 0, 0.0, 0.0]
    for doc, text, _ in docs:
        own, k = grams(text), known.get(doc)
        raw.update(own)
        if k is not None and not k["held"]:
            for c, x in ((seen, 1), (single, k["share"]), (target, k["share"] * k["good"])):
                for g in own:
                    c[g] += x
            totals = [totals[0], totals[1] + 1, totals[2] + k["share"], totals[3] + k["share"] * k["good"]]

    def ratio(g):
        expected = raw[g] * (single[g] / seen[g] if seen[g] else 1) * totals[3] / (totals[0] * totals[2] / totals[1])
        t = target[g]
        r = math.log((t + 1) / (expected + 1))
        deviance = (t * math.log(t / expected) if t else 0) - t + expected
        return r if deviance >= (1 if r > 0 else 8) and (r > 0 or r < -math.log(3)) else 0

    want = []
    for _, text, _ in docs:
        r = [ratio(g) for g in grams(text)]
        above = [x for x in r if x > 0]
        want.append(sum(x for x in r if x < 0) + sum(above) / max(1, len(above)))
    rows = resampled(frame, marks, keep=700).orderBy("doc_id", "mark").collect()
    by = {(d, F_) for d, F_ in [(r["doc_id"], round(r["log_weight"], 3)) for r in rows]}
    assert by == {(d, round(w, 3)) for (d, _, _), w in zip(docs, want)} and min(want) < -2 < 0 < max(want)
    # Gumbel top-k: the keys are weights with noise, the 700 largest stay
    keys = sorted((r["key"] for r in rows), reverse=True)
    assert all(r["kept"] == (r["key"] >= keys[699]) for r in rows)
    noise = [r["key"] - r["log_weight"] for r in rows]
    assert abs(sum(noise) / len(noise) - 0.5772) < 0.12 and abs(sum(n < 0 for n in noise) / len(noise) - math.exp(-1)) < 0.05


def test_kth_largest(spark):
    rows = spark.createDataFrame([(float(x),) for x in [5, 1, 1, 1, 3, 9, -4]], "v double")
    assert [kth_largest(rows, "v", k, most=3) for k in (1, 2, 3, 4, 6, 7)] == [9.0, 5.0, 3.0, 1.0, 1.0, -4.0]


def test_html_articles_keep_what_recurs(spark):
    post = "<body><div class='x1'><span>Home</span><span>Shop</span></div><article><h2>Background</h2><p>Of %d it is said that nobody else knows.</p><h2>Conclusion</h2><p>We thank all who read this far.</p></article></body>"
    teased = "<body><article><h1>News %d</h1><p>What happened on day %d and was told nowhere else.</p></article><article><p>Read our best of the year</p></article></body>"
    main = "<body><main><p>The real body of page %d, which is longer than what a teaser says of it.</p><p>And more.</p><article>Next: page</article></main></body>"
    inline = '<article><p>Before <span class="ad"><span>buy</span> now now</span>after %d.</p><p class="related">Related work is text.</p><div class="header">As is this.</div><b class="advert">gone</b></article>'
    rows = [(100 * k + i, f"https://{'abcd'[k]}.example/{i}", h % ((i,) * h.count("%d"))) for k, h in enumerate((post, teased, main, inline)) for i in range(12)]
    text = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):
        assert text[i] == f"Background\nOf {i} it is said that nobody else knows.\nConclusion\nWe thank all who read this far."
        assert text[100 + i] == f"News {i}\nWhat happened on day {i} and was told nowhere else."
        assert text[200 + i] == f"The real body of page {i}, which is longer than what a teaser says of it.\nAnd more."
        assert text[300 + i] == f"Before after {i}.\nRelated work is text.\nAs is this."


def test_html_reading_takes_time_in_proportion(spark):
    from time import process_time

    from larkspur.llm.extract import read_page

    for page in ("<b>" * 100_000 + "</i>" * 100_000, "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000, "<td>" * 50_000 + "<tr>" * 50_000, "<ul>" + "<span>" * 100_000 + "<li>" * 50_000):
        began = process_time()
        read_page(page)
        assert process_time() - began < 10


def test_html_templates_and_class_words(spark):
    kept = '<article class="post no-sidebar"><p>Body %d of a long enough kind.</p></article>'
    work = '<body><div class="related-work"><p>Earlier work %d</p></div><div class="related-posts">more</div><div class="post-comments"><p>first!</p></div></body>'
    menu = "<body><div><div><span>Start</span><span>Shop</span><span>Help</span></div><div><p>Story %d tells what nobody else said.</p><p>The same in all.</p></div></div></body>"
    rows = [(i, f"https://a.example/{i}", kept % i) for i in range(2)] + [(10 + i, f"https://b.example/{i}", work % i) for i in range(2)]
    rows += [(20 + i, f"https://c.example/{i}", menu % i) for i in range(6)] + [(30 + i, f"https://d.example/{i}", menu % i) for i in range(2)]
    rows += [(40, "https://e.example/", "<div>" * 3000 + "deep" + "</p>" * 9), (41, "https://e.example/long", "<p>" + "word &amp; " * 100_000)]
    text = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert text[0] == "Body 0 of a long enough kind." and text[10] == "Earlier work 0"
    # a menu without a telling name goes where enough pages show that it is one
    assert all(text[20 + i] == f"Story {i} tells what nobody else said." for i in range(6)) and text[30].startswith("StartShopHelp")
    assert text[40] == "deep" and text[41] == " ".join(["word &"] * 100_000)
