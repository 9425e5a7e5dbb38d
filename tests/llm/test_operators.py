"""The training-data operators against brute force, over one small table with all edge cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reviewlake.llm import _hashing, _shared, decontaminate, html_extract, line_dedup, mixing, ngram_join, quality, sharding, suffix_dedup, token_orc, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot string, host string"
BENCH = "item_id long, text string"
WORDS = [f"w{k}" for k in range(60)] + ["é", "Über", "naïve"]


def rows():
    rnd = random.Random(7)
    say = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    base = say(80)
    passage = say(20)
    texts = [say(rnd.randrange(1, 90)) for _ in range(14)]
    texts += [base, base, base + " tail", base.replace("w1 ", "w2 ", 1), base.upper()]  # copies and near copies
    texts += [say(10) + "\n" + passage + "\n" + say(5), passage, say(30) + " " + passage]  # a shared passage
    texts += [None, "", "   \n\t ", "x", "one two", "\n\n", "a  b\r\nc", "aaaa" * 60, "aaaa" * 50, "aaaa" * 60]
    texts += ["Line one is here again\n" * 3 + "other", "# a | b & c\n# a | b & c", say(3000) + " " + base]
    out = [(k, t, "en", f"s{k % 4}" if k % 9 else None, len(t or "")) for k, t in enumerate(texts)]
    out += [out[14], out[14], (3, "another text of a repeated id " + passage, "en", "s1", 1), (None, say(60), None, None, None), (None, passage, None, "s0", 0)]
    return [(*r, "x", "y") for r in out]


ROWS = rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return tuple((v is None, str(v)) for v in row)


def listed(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# 1
def test_mix(docs, empty):
    got = mixing.mix(docs, shard_words=400).collect()
    assert len(got) == len(ROWS)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(words(r[1]))) for r in ROWS)
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    want, left, open_ = {}, float(sum(sizes.values())), list(order)
    while True:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            want[s] = 3.0 * sizes[s]
            left -= want[s]
            open_.remove(s)
    want |= {s: weight[s] * level for s in open_}
    assert target == pytest.approx(want)
    for s in order:
        assert abs(taken[s] - want[s]) <= 40, s
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix(docs, shard_words=400).collect()))
    assert mixing.mix(empty).count() == 0
    again = mixing.drawn(docs)
    assert again.columns == docs.columns and again.count() > 0


def test_apportion(spark):
    votes = [340.5, 100, 99, 12, 0]
    for seats in (0, 1, 7, 100):
        df = spark.createDataFrame([(0, k, float(v), seats) for k, v in enumerate(votes)], "g int, p int, v double, n long")
        got = {r.p: r.won for r in mixing.apportion(df, ["g"], ["p"], "v", "n", "won").collect()}
        want = Counter(k for _, k, _ in sorted(((-v / (2 * i + 1), k, i) for k, v in enumerate(votes) if v for i in range(seats)))[:seats])
        assert got == {k: want[k] for k in range(len(votes))}


# 2
LONG = "Some words of an article that goes on for a while. " * 4
PAGES = [
    ("<html><body><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>First  text\n here.<br>more<p><b>Open <i>tags</b></article><aside>side</aside><footer>f</footer></body>", "A & B\nFirst text here. more\nOpen tags"),
    ("<header>Site</header><div class='main-menu'><a>x</a></div><div id=content><h2>T</h2><p>A long paragraph of real content that goes on.</p><p>Another long paragraph of content&nbsp;here too.</p></div><div class='comments'><p>I do not agree with this at all, says a reader.</p></div><form><p>Subscribe to our newsletter now please</p></form>", "T\nA long paragraph of real content that goes on.\nAnother long paragraph of content here too."),
    (None, ""), ("", ""), ("no tags at all", "no tags at all"), ("<script>var a = '<p>x</p>';</script><style>p{}</style>", ""),
    ("<article class='post'><p>Body.</p><div class=ad>Buy now</div><section id='comments'><p>reader</p></section></article>", "Body."),
    # End tags left out, void elements with hints, hints that say how a page is laid out or hold the whole article.
    ("<p class=promo>Buy now<p>" + LONG, LONG.strip()),
    ("<ul><li class=ad>buy<li>one<li>two</ul><p>" + LONG, "one\ntwo\n" + LONG.strip()),
    ("<div><hr class='ad-line'><p>hello there</p></div>", "hello there"),
    ("<head><title>x</title><p>hello", "hello"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\nc"),
    ("<article class='post has-sidebar'><p>Body.</p></article>", "Body."),
    ("<div class='layout with-sidebar'><form><h1>T</h1><p>" + LONG + "<p>short</form></div>", "T\n" + LONG.strip() + "\nshort"),
    ("<section class=discussion><article><p>" + LONG + "</article></section>", LONG.strip()),
    ("<article><h1>T</h1><div class='legal analysis'>Of the law.</div><p>" + LONG + "</article>", "T\nOf the law.\n" + LONG.strip()),
    ("<main><h1>T</h1><article><p>" + LONG + "</article><div id=comments><article class=comment><p>" + LONG * 3 + "</article></div></main>", "T\n" + LONG.strip()),
    ("<article><p>" + LONG + "<div class=related><h3>More</h3><a href=x>Another of our articles</a></div></article>", LONG.strip()),
    ("<article><p>x <span class=ad>buy</span> y</article>", "x y"),
    # No article element: the cluster names the region.
    ("<div id=x><a href=a>Home</a> <a href=b>News</a></div><div id=y><h1>T</h1><div><p>" + LONG + "<p>short<p>" + LONG + "</div></div><div id=z><a href=c>Imprint</a></div>", "T\n" + LONG.strip() + "\nshort\n" + LONG.strip()),
    ("<div><p>" + LONG + "<p>" + LONG * 3 + "</div><div><div>Small print</div></div>", LONG.strip() + "\n" + (LONG * 3).strip()),
]


def test_clusters():
    """Smoothing and threshold against plain sums and against all splits."""
    draw = random.Random(7)
    for _ in range(50):
        values = [draw.choice((0.0, draw.random() * 5, 50 + draw.random() * 50)) for _ in range(draw.randint(2, 30))]
        weights = {d: math.exp(-d * d / 2) for d in (-2, -1, 0, 1, 2)}
        plain = [sum(w * values[k + d] for d, w in weights.items() if 0 <= k + d < len(values)) / sum(weights.values()) for k in range(len(values))]
        assert html_extract.smoothed(values) == pytest.approx(plain)
        limit = html_extract.threshold(plain)
        low, high = [v for v in plain if v <= limit], [v for v in plain if v > limit]
        if high:  # the limit is half-way between the means of its sides
            assert limit == pytest.approx((sum(low) / len(low) + sum(high) / len(high)) / 2)


def test_extract(spark):
    pages = spark.createDataFrame([(k, None if k == 2 else "u", h, 1) for k, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, extra int")
    assert [(r.page_id, r.text, r.n_chars) for r in html_extract.extract(pages).orderBy("page_id").collect()] == [(k, t, len(t)) for k, (_, t) in enumerate(PAGES)]
    assert html_extract.extract(pages.limit(0)).count() == 0
    assert html_extract.main_text("<p>" + "word " * 200_000) == " ".join(["word"] * 200_000)


# 3
def items():
    long = ROWS[19][1]
    return [(1, ROWS[20][1]), (10, ROWS[20][1].upper() + " extra"), (2, "one two"), (3, None), (4, "!!"), (None, "x"), (5, " ".join(long.split()[2:18])), (1, ROWS[20][1])]


def test_decontaminate(spark, docs, empty):
    bench = spark.createDataFrame(items(), BENCH)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in ROWS])
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items())
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({decontaminate.oracle()})").fetchall(), key=key)
    assert listed(decontaminate.judge(docs, bench), *names) == want
    assert any(r[5] for r in want) and not all(r[5] for r in want)
    assert decontaminate.judge(empty, bench).count() == 0
    assert decontaminate.judge(docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.clean(docs, bench).columns == docs.columns


# 4
def test_table():
    names = [f"n{k}" for k in range(5)]
    walks = [sharding.preference(n, 101) for n in names]
    claimed, turn = {}, 0
    while len(claimed) < 101:
        first, step = walks[turn % 5]
        claimed[next(s for s in ((first + k * step) % 101 for k in range(101)) if s not in claimed)] = turn % 5
        turn += 1
    table = sharding.lookup_table(names, 101)
    assert table == [claimed[k] for k in range(101)]
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1
    fewer = sharding.lookup_table(names[:4], 101)
    assert sum(a != b for a, b in zip(table, fewer, strict=True)) < 50


def test_place(docs, empty):
    placed = sharding.place(docs)
    assert placed.count() == len(ROWS) and placed.columns[-2:] == ["slot", "shard"]
    assert placed.groupBy("doc_id").agg(F.countDistinct("shard").alias("n")).filter("n > 1").count() == 0
    assert sharding.place(empty).count() == 0


# 5
def test_quality(spark, docs, empty):
    got = listed(quality.judge(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = []
    for doc_id, text, *_ in ROWS:
        text = text or ""
        w = words(text)
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        marked = {k + j for k, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for j in range(3)}
        lines = text.split("\n")
        dup = sum(bool(words(x)) and x in lines[:k] for k, x in enumerate(lines))
        want.append((doc_id, len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(marked), len(w) < 50 or 100 * len(marked) > 50 * len(w)))
    assert got == sorted(want, key=key)
    assert quality.judge(empty).count() == 0
    assert quality.keep(docs).columns == docs.columns
    plate = "This site uses cookies and other boilerplate words to fill the page " * 4
    own = [f"unique{k} " * 3 + " ".join(f"u{k}x{j}" for j in range(60)) for k in range(40)]
    many = [(k, plate + "\n" + own[k] if k < 20 else own[k] if k < 38 else plate + f"\nleft{k}", "en", "h", 0, "", "") for k in range(40)]
    many += [(100 + k, plate + f"\nrest {k}", "en", "h", 0, "", "") for k in range(10)]
    kept = {r.doc_id: (r.base_failed, r.kept) for r in quality.judge(spark.createDataFrame(many, SCHEMA)).collect()}
    assert all(kept[k][1] for k in range(38))
    assert not any(kept[100 + k][1] for k in range(10))


def plain_rules(rows, limit=quality.LINE_DOCS):
    """(row with its text cleaned, removed words, kept) by plain loops; rows are (doc_id, text, source)."""
    norm = lambda x: " ".join(words(x)).lower()
    seen = defaultdict(set)
    for doc_id, text, source in rows:
        for x in (text or "").split("\n"):
            if norm(x):
                seen[source, norm(x)].add((doc_id is None, doc_id or 0, text))
    out = []
    for doc_id, text, source in rows:
        me = (doc_id is None, doc_id or 0, text)
        gone = [x for x in (text or "").split("\n") if norm(x) and len(docs := seen[source, norm(x)]) > limit and min(docs) != me]
        left = None if text is None else "\n".join(x for x in text.split("\n") if x not in gone)
        w = words(text)
        grams = list(zip(w, w[1:], w[2:], strict=False))
        counts = Counter(grams)
        marked = {k + j for k, g in enumerate(grams) if counts[g] > 1 for j in range(3)}
        failed = len(w) < 50 or 2 * len(marked) > len(w)
        out.append(((doc_id, left, source), sum(len(words(x)) for x in gone), not failed and 4 * len(words(left)) >= len(w)))
    return out


def boilerplate():
    """Sources in which lines are in many documents, in several spellings, alone or not, and in copies of a text."""
    say = lambda k, n: " ".join(f"u{k}x{j}" for j in range(n))
    rows = []
    for k in range(60):
        source = (None, "a", "b")[k % 3] if k < 30 else "a"
        plate = ("All rights  reserved", "ALL RIGHTS\treserved ", "all rights reserved")[k % 3]
        rows.append((k, f"{say(k, 40)}\n{plate}\n\n{say(k, 30)[::-1]}\n{plate}\n", source))
    rows += [(100 + k, f"Ünder Licence A\n{say(100 + k, 60)}" if k != 7 else "Ünder Licence A", "c") for k in range(24)]
    rows += [(200 + k, f"{say(1, 60)}\none text in copies", "d") for k in range(25)]
    rows += [(300 + k, f"{say(7, 300)}\n{say(300 + k, 55)}", "e") for k in range(22)]
    return rows + [(400, None, "a"), (401, "", "a"), (None, f"{say(9, 60)}\nall rights reserved", "a")]


def test_quality_cleans(spark, monkeypatch):
    rows = boilerplate()
    names = "doc_id long, text string, source string, host int, text_hash string, _drop string, kept int, n_words int, doc int"
    extra = (1, "t", "d", 2, 3, 4)
    table = spark.createDataFrame([(*r, *extra) for r in rows], names).repartition(3)
    rows, table = [*rows, rows[0]], table.unionByName(table.filter("doc_id = 0"))  # a repeated row
    want = plain_rules(rows)
    kept = quality.keep(table)
    assert kept.columns == table.columns
    assert listed(kept, "*") == sorted(((*r, *extra) for r, _, yes in want if yes), key=key)
    assert listed(quality.judge(table), "doc_id", "removed_words", "kept") == sorted(((r[0], n, yes) for r, n, yes in want), key=key)
    assert any(n and yes for _, n, yes in want) and any(n and not yes for _, n, yes in want)
    assert sum("reserved" in (r[1] or "").lower() for r, _, yes in want if yes and r[2] == "a") == 1
    monkeypatch.setattr(quality, "MOST_BROADCAST", 0)
    monkeypatch.setattr(_shared, "MOST_BROADCAST", 0)
    assert listed(quality.keep(table), "*") == listed(kept, "*")
    assert quality.keep(table.limit(0)).count() == 0


def test_quality_on_a_hot_source(spark):
    """The same licence line goes from a source of 600 texts and from one of 30; of a text in many copies the first stays."""
    own = lambda k: " ".join(f"v{k}x{j}" for j in range(55))
    rows = [(1000 * s + k, ("licence line\n" if k < 25 else "") + ("in twenty\n" if k < 20 else "") + own(1000 * s + k), f"s{s}") for s, n in ((0, 600), (1, 30)) for k in range(n)]
    want = [(d, t if d in (0, 1000) else t.replace("licence line\n", ""), s) for d, t, s in rows] + [(5000, own(9), "s2")]
    rows += [(5000 + k, own(9), "s2") for k in range(50)]
    got = quality.keep(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert listed(got, "*") == sorted(want, key=key) == sorted((r for r, _, yes in plain_rules(rows) if yes), key=key)


# 6
def test_tokens(spark, docs, empty, tmp_path, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    token_orc.write_tokens(docs, str(tmp_path / "t"), path)
    tokens = token_orc.read_tokens(spark, str(tmp_path / "t"))
    got = sorted(token_orc.summary(tokens).collect(), key=lambda r: (r.start, r.n_tokens))
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda x: (x is not None, x))
    want = Counter()
    for doc_id, text, *_ in ROWS:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        want[doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert tokens.filter("doc_id = 20").count() == 1
    rnd = random.Random(5)
    bits = ["a", "B", "é", " ", "  ", "\n", "\t", "\0", ".", "'s", "22", "averylongwordofletters", "\u3000", "中文", "«", "<|endoftext|>", "\r\n", "\x1c", "\x85", "🙂", "!?", ")", "ß"]
    own = token_orc.Encoder(path)
    for limit in (1_000_000, 50):  # with a memory that never and one that often runs full
        monkeypatch.setattr(token_orc, "REMEMBER", limit)
        own.forget()
        for k in range(60):
            texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(25))).replace("<|", "<|" if k % 2 else "") for _ in range(60)] + [None]
            ids, counts = own.encode(pa.array(texts, pa.string()))
            assert ids.tolist() == [x for t in texts for x in [*plain.encode(t or "", add_special_tokens=False).ids, 2]]
            assert len(counts) == len(texts)
    token_orc.write_tokens(empty, str(tmp_path / "e"), path)
    assert token_orc.summary(token_orc.read_tokens(spark, str(tmp_path / "e"))).count() == 0


# 7
def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_automaton():
    rnd = random.Random(1)
    terms = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(3, 8))) for _ in range(30)]
    trie = toxicity.trie_of(terms)
    for _ in range(400):
        word = "".join(rnd.choice("abc") for _ in range(rnd.randrange(2, 9)))
        for most in (0, 1, 2):
            assert (toxicity.near(trie, word, most) is not None) == any(distance(word, t) <= most for t in terms)


def test_stems_and_pieces():
    """Stems by a beginning of a word; the filter by pieces loses no target."""
    rnd = random.Random(2)
    draw = lambda low, high: "".join(rnd.choice("abc") for _ in range(rnd.randint(low, high)))
    terms, stems = frozenset(draw(3, 11) for _ in range(12)), frozenset(draw(4, 8) for _ in range(3))
    model = toxicity.Model(terms, stems)
    able = lambda words: [t for t in words if toxicity.allowed(len(t))]
    for _ in range(600):
        word = draw(2, 13)
        most = toxicity.allowed(len(word))
        want = {t for t in able(terms) if distance(word, t) <= most}
        want |= {t + "*" for t in able(stems) if any(distance(word[:k], t) <= min(most, toxicity.allowed(len(t))) for k in range(len(word) + 1))}
        assert set(toxicity.nears(model.trie, word, most)) == want
        assert not want or not most or model.maybe(word)


def test_toxicity(spark, docs):
    rnd = random.Random(3)
    clean = [f"c{k}" for k in range(300)]
    bad = ["horrible", "rotten", "vile", "nasty"]
    data, labels = [], []
    for k in range(900):
        toks = [rnd.choice(clean) for _ in range(30)]
        toxic = k % 4 == 0
        if toxic:
            for _ in range(3):
                toks.insert(rnd.randrange(30), rnd.choice(bad))
        data.append((k, " ".join(toks), "", "", 0, "", ""))
        labels.append((k, 1, int(toxic)))
    data += [(5000, "c1 c2 horrble c3 horible c4 rottn c5", "", "", 0, "", ""), (5001, 'c1 he said "horrible" c2 c3', "", "", 0, "", ""), (5002, None, "", "", 0, "", ""), (5003, "", "", "", 0, "", "")]
    table, told = spark.createDataFrame(data, SCHEMA), spark.createDataFrame([*labels, (None, 1, 1), (5002, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(table, told)
    assert set(bad) <= model.terms
    got = {r.doc_id: r for r in toxicity.score(table, model).collect()}
    held = [(got[k].predicted, t) for k, _, t in labels if got[k].held_out]
    assert held and sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k in got)
    assert got[5000].predicted == 1 and got[5001].predicted == 0 and got[5002].score == got[5003].score < 0.5
    assert toxicity.score(table.limit(0), model).count() == 0
    again = toxicity.score(table.union(table).withColumn("score", F.lit("x")), model)  # repeated rows, a clashing column
    assert again.count() == 2 * table.count() and again.groupBy("doc_id").agg(F.countDistinct("score").alias("n")).filter("n > 1").isEmpty()
    none = toxicity.fit(docs, told.limit(0))
    assert toxicity.score(docs, none).select("score").distinct().count() == 1


# 8
def test_suffix_array():
    rnd = random.Random(3)
    for t in range(150):
        text = np.array([rnd.randrange(rnd.choice([2, 3, 255])) for _ in range(rnd.randrange(1, 150))], np.uint8)
        text = np.tile(text[:7], 9) if t % 3 == 0 else text
        data = text.tobytes()
        order = sorted(range(len(data)), key=lambda i: data[i:])
        assert suffix_dedup.suffix_array(text).tolist() == order
        shared = suffix_dedup.common_prefixes(text, np.array(order), 50)
        for a, b in zip(order, order[1:], strict=False):
            n = next((k for k in range(50) if a + k >= len(data) or b + k >= len(data) or data[a + k] != data[b + k]), 50)
            assert shared[b] == n


def test_repeats(docs, empty):
    texts = [(r[0], (r[1] or "").encode()) for r in ROWS]
    first = {}
    for doc_id, t in sorted(texts, key=lambda x: (x[0] is None, x[0])):
        for k in range(len(t) - 49):
            first.setdefault(t[k : k + 50], doc_id)
    want = []
    for doc_id, t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 49):
            owner = first[t[k : k + 50]]
            if owner is not None and (doc_id is None or owner < doc_id):
                gone[k : k + 50] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(t) else 0
        want.append((doc_id, len(t), int(gone.sum()), spans, sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    assert listed(suffix_dedup.remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=key)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_long_text_is_cut_alike(spark, monkeypatch):
    rnd = random.Random(4)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(9000))
    table = spark.createDataFrame([(1, text), (2, "zz" + text[100:]), (3, text[5000:5049])], "doc_id long, text string")
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    data = np.frombuffer(text.encode(), np.uint8)
    row, at, span, _, _ = suffix_dedup.bucket_stretches(data, np.array([0, len(data)]))
    windows = sorted(w for a, s in zip(at, span, strict=True) for w in range(a, a + s + 1))
    assert windows == list(range(len(text) - 49)) and not row.any()
    assert [(r.doc_id, r.n_removed) for r in suffix_dedup.remove_repeats(table).orderBy("doc_id").collect()] == [(1, 0), (2, 8900), (3, 0)]


def test_repeats_of_random_passages(spark):
    """Many documents of pieces of few passages, so that most minimisers have several classes, and all bytes are compared."""
    rnd = random.Random(8)
    base = ["".join(rnd.choice("abcd ") for _ in range(rnd.randrange(20, 200))) for _ in range(12)]
    texts = []
    for k in range(120):
        parts = [p[rnd.randrange(len(p)) :] if rnd.random() < 0.5 else p for p in rnd.sample(base, 3)]
        texts.append((k % 100, "é".join(parts)))
    first, want = {}, []
    for doc_id, t in sorted(texts):
        t = t.encode()
        for k in range(len(t) - 49):
            first.setdefault(t[k : k + 50], doc_id)
    for doc_id, t in texts:
        t = t.encode()
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < doc_id:
                gone[k : k + 50] = True
        want.append((doc_id, len(t), int(gone.sum()), sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    got = suffix_dedup.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string").repartition(3))
    assert listed(got, "doc_id", "n_bytes", "n_removed", "kept_sha256") == sorted(want, key=key)
    assert 20 < sum(w[2] > 0 for w in want) < 120


# 9
def test_lines(docs, empty):
    order = sorted(ROWS, key=lambda r: (r[0] is None, r[0]))
    occurrences = []
    for r in order:
        for k, line in enumerate((r[1] or "").split("\n") if r[1] is not None else []):
            if s := frozenset(line.encode().lower().split()):
                occurrences.append((r[0], k, s))
    got = {}
    for r in line_dedup.dedup(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    once = [r for r in order if sum(x[0] == r[0] for x in ROWS) == 1]  # repeated ids are ordered by a hash
    place = {r[0]: k for k, r in enumerate(order)}
    for r in once:
        lines = [] if r[1] is None else r[1].split("\n")
        gone = set()
        for k, line in enumerate(lines):
            s = frozenset(line.encode().lower().split())
            for d, j, other in occurrences:
                if s and (place[d], j) < (place[r[0]], k) and 5 * len(s & other) >= 4 * len(s | other):
                    gone.add(k)
        row = got[r[0]][0]
        assert (row.n_lines, row.n_removed) == (len(lines), len(gone)), r[0]
        assert row.kept_sha256 == sha256("\n".join(x for k, x in enumerate(lines) if k not in gone).encode()).hexdigest()
    assert sum(len(v) for v in got.values()) == len(ROWS)
    assert line_dedup.dedup(empty).count() == 0


def test_postings_are_dealt_by_task(monkeypatch):
    """A task's blobs go by shards, not by pieces times shards, and hold the postings of all its pieces."""
    monkeypatch.setattr(line_dedup, "PIECE", 200)
    texts = [" ".join(f"w{(7 * k + j) % 90}" for j in range(12)) + "\nshared line" for k in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array([0] * 300, pa.int64()), pa.array(texts)], ["doc", "tie", "text"])
    post = line_dedup._post(8, line_dedup._order(np.zeros(line_dedup.ENTRIES, np.int64)), line_dedup.PERCENT)
    rows = [row for out in post(iter([batch])) for row in zip(*(out.column(c).to_pylist() for c in ("shard", "kind", "rows")), strict=True)]
    assert len(rows) == len({r[:2] for r in rows}) <= 3 * 8
    got = line_dedup.unpack([r[2] for r in rows if r[1] == line_dedup.PAIR], line_dedup.POSTINGS)
    # A line of 12 words posts 3, one of 2 posts 1, once a piece.
    assert {k: int((got["n"] == k).sum()) for k in (2, 12)} == {2: len(list(line_dedup.pieces(batch.column("text")))), 12: 3 * 300}


@pytest.mark.parametrize("small", [False, True])
def test_groups_of_alike_lines(spark, monkeypatch, small):
    """Lines near the threshold in large groups, of all lengths; with small bounds, by blocks and by a second search."""
    rnd = random.Random(12)
    if small:
        for name, value in (("BLOCK", 10), ("AT_ONCE", 1), ("FIRST", 1), ("NEAR", 1), ("HELD", 50), ("PIECE", 3000)):
            monkeypatch.setattr(line_dedup, name, value)
    texts = []
    for k in range(90):
        lines = []
        for g, n in enumerate((1, 2, 3, 5, 9, 12, 30, 70, 150, 400)):
            w = [f"g{g}w{j}" for j in range(n)]
            for _ in range(rnd.randrange(1, 2 + n // 9)):
                w[rnd.randrange(n)] = f"x{rnd.randrange(300)}"
            rnd.shuffle(w)
            lines.append(" ".join(w))
        texts.append((k if k % 11 else k // 11, "\n".join(rnd.sample(lines, 4))))
    told = {}
    for k, (d, t) in enumerate(texts):
        told[k] = [frozenset(x.split()) for x in t.split("\n")]
    got = {(r.doc_id, r.n_removed, r.kept) for r in line_dedup.dedup(spark.createDataFrame(texts, "doc_id long, text string").repartition(4)).collect()}
    ids = Counter(d for d, _ in texts)
    for k, (d, t) in enumerate(texts):
        if ids[d] > 1:
            continue
        lines, gone = t.split("\n"), set()
        for j, s in enumerate(told[k]):
            for i, (e, _) in enumerate(texts):
                if e < d or i == k:
                    for m, other in enumerate(told[i]):
                        if (e < d or m < j) and 5 * len(s & other) >= 4 * len(s | other):
                            gone.add(j)
        assert (d, len(gone), "\n".join(x for j, x in enumerate(lines) if j not in gone)) in got, d


# 10
def brute_components(texts, size, percent):
    sets = []
    for doc_id, text in texts:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append((doc_id, frozenset(zip(*(w[k:] for k in range(size)), strict=False)) if len(w) >= size else frozenset([tuple(w)] if w else [])))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc_id, s) in enumerate(sets):
        least[find(i)] += [doc_id] if doc_id is not None else []
    return sorted(((d, len(s), min(least[find(i)], default=None) if s else d) for i, (d, s) in enumerate(sets)), key=key)


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_components(docs, empty, monkeypatch, size, percent):
    if size == 3:
        monkeypatch.setattr(ngram_join, "MOST_LINKS", 0)
        monkeypatch.setattr(ngram_join, "MOST_BROADCAST", 0)
    want = brute_components([r[:2] for r in ROWS], size, percent)
    assert listed(ngram_join.components(docs, size, percent), "doc_id", "n_shingles", "component_id") == want
    assert ngram_join.components(empty, size, percent).count() == 0


def test_near_copies_in_blocks(spark, monkeypatch):
    """A group of near copies of which few link, compared in small blocks, and small sets of every size."""
    rnd = random.Random(11)
    base = [f"b{k}" for k in range(60)]
    texts = []
    for k in range(60):
        w = list(base)
        for _ in range(rnd.randrange(1, 7)):
            w[rnd.randrange(60)] = f"n{rnd.randrange(400)}"
        texts.append((k, " ".join(w)))
    for k in range(40):
        texts.append((100 + k, " ".join(f"s{j}" for j in range(k % 20) if rnd.random() > 0.05)))
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    table = spark.createDataFrame(texts, "doc_id long, text string")
    for size, percent in ((1, 90), (1, 80), (3, 80)):
        assert listed(ngram_join.components(table, size, percent), "doc_id", "n_shingles", "component_id") == brute_components(texts, size, percent)


def test_boundary():
    """Few and short lists: only the smallest sets are enumerated; long lists move the boundary up; large sets never are."""
    sizes = np.full(ngram_join.SMALL + 2, 100)
    low, high = (ngram_join.boundary(90, ngram_join.light_groups(90, sizes, x)) for x in (1.0, 1000.0))
    assert 0 < low < high < ngram_join.SMALL
    assert ngram_join.list_length(np.array([4, 0, 0, 0])) == 3 and ngram_join.list_length(np.zeros(4)) == 0


def test_links_through_rows_without_an_id(spark):
    w = [f"w{k}" for k in range(45)]
    texts = [(1, " ".join(w[:42])), (None, " ".join(w[1:43])), (2, " ".join(w[2:44]))]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    want = brute_components(texts, 3, 90)
    assert [c for _, _, c in want] == [1, 1, 1]
    assert listed(ngram_join.components(table, 3, 90), "doc_id", "n_shingles", "component_id") == want


def test_keep_one(spark, docs, empty):
    """One row of each component, by row and not by id alone; names like ours are kept."""
    say = lambda k: " ".join(f"{k}x{j}" for j in range(40))
    rows = [(3, say(1)), (5, say(1) + " tail"), (5, say(2)), (5, say(2)), (None, say(2)), (None, say(3)), (None, say(3) + " z"), (7, ""), (7, ""), (8, None)]
    table = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in rows], "doc_id long, text string, _doc int, _row int, sig int")
    kept = ngram_join.keep_one(table)
    assert kept.columns == table.columns
    got = listed(kept, "doc_id", "text")
    assert got[:5] == sorted([(3, say(1)), (5, say(2)), (7, ""), (7, ""), (8, None)], key=key)
    assert len(got) == 6 and got[5][0] is None and got[5][1].startswith("3x0")
    assert ngram_join.keep_one(empty).count() == 0


def test_hashes_of_regular_words():
    """Words on which every polynomial hash modulo 2**64 is equal, and spans of all lengths."""
    a = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    texts = [a, b, "a" * 7, "a" * 8, "a" * 9, "a" * 64, "a" * 65, "a" * 64 + "b", "\0", "\0\0", "a\0", "a", *(f"{k:09d}" for k in range(2000))]
    found = np.concatenate([h for _, _, _, h in _hashing.words(pa.array(texts))])
    assert len(found) == len(set(found.tolist())) == len(texts)
