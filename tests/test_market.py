import json
import random
from collections import Counter
from datetime import date
from hashlib import sha256

from pyspark.sql import Window
from pyspark.sql import functions as F

from seasonframe import schemas as S
from seasonframe.operators import listing, market
from seasonframe.operators.ranks import dense_ranks

D1, D2, D3 = date(2026, 5, 1), date(2026, 5, 8), date(2026, 5, 15)


def frame(spark, rows):
    return spark.createDataFrame(rows, S.MARKET_VALUES)


def test_fingerprint_ignores_order_and_sees_content(spark):
    rows = [(D1, i, f"n{i % 7}", None if i % 3 else "SF", i % 5, "QB") for i in range(60)]
    shuffled = [(D2, *r[1:]) for r in random.Random(1).sample(rows, len(rows))]
    other = [(D3, *r[1:]) for r in rows[:-1]] + [(D3, 59, "n3", "SF", 99, "QB")]
    got = {r.snapshot_date: r[1:] for r in market.fingerprints(frame(spark, rows + shuffled + other)).collect()}
    assert got[D1] == got[D2] != got[D3]
    changed = {r.snapshot_date: r.changed for r in market.snapshot_changes(frame(spark, rows + shuffled + other)).collect()}
    assert changed == {D1: True, D2: False, D3: True}


def test_ratio_uses_the_first_old_row_of_a_name(spark):
    old = frame(spark, [(D1, 0, "a", "SF", 10, None), (D1, 1, "a", "KC", 20, None), (D1, 2, "b", None, 5, None), (D1, 3, "c", None, 1, None)])
    new = frame(spark, [(D1, 0, "a", "KC", 20, None), (D1, 1, "a", "SF", 10, None), (D1, 2, "b", None, 5, None), (D1, 3, "new", None, 1, None)])
    r = market.change_ratio(old, new).first()
    assert (r.changed_n, r.prev_n, r.ratio) == (2, 4, 0.5)


def test_ratio_with_a_hot_name(spark):
    old = frame(spark, [(D1, i, "hot" if i % 3 == 0 else f"n{i}", None, i % 4, None) for i in range(900)])
    new_rows = [(D1, i, "hot" if i % 3 == 0 else f"n{i}", None, i % 5, None) for i in range(900)]
    first = {}
    for r in [(D1, i, "hot" if i % 3 == 0 else f"n{i}", None, i % 4, None) for i in range(900)]:
        first.setdefault(r[2], r[4])
    expected = sum(1 for r in new_rows if first.get(r[2]) != r[4])
    assert market.change_ratio(old, frame(spark, new_rows)).first().changed_n == expected


def test_guard_verdicts(spark):
    df = spark.createDataFrame([(0.70,), (0.71,)], "ratio DOUBLE")
    assert [r.passed for r in market.guard_ratio(df).orderBy("ratio").collect()] == [True, False]
    cases = [(8.0, True, True, True), (8.1, True, True, False), (None, True, True, False), (1.0, False, True, False), (1.0, True, False, False)]
    df = spark.createDataFrame(cases, "age DOUBLE, base BOOLEAN, ran BOOLEAN, want BOOLEAN")
    got = df.select("want", market.guard_applies(F.col("age"), F.col("base"), F.col("ran")).alias("g")).collect()
    assert all(r.want == r.g for r in got)


def test_trend_and_latest(spark):
    df = frame(spark, [(D1, 0, "a", None, 10, None), (D1, 1, "a", "KC", 99, None), (D3, 0, "a", None, 7, None), (D2, 0, "b", None, 1, None)])
    rows = {(r.name, r.snapshot_date): (r.value, r.previous, r.delta) for r in market.value_trend(df).collect()}
    assert rows == {("a", D1): (10, None, None), ("a", D3): (7, 10, -3), ("b", D2): (1, None, None)}
    assert [r.name for r in market.latest_snapshot(df).collect()] == ["a"]
    assert market.latest_snapshot(df.limit(0)).count() == 0


def test_names(spark):
    df = frame(spark, [(D1, 0, "D.J. Moore", "CHI", 1, "WR"), (D1, 1, "Josh Allen", None, 2, "QB"), (D1, 2, "Nobody", None, 3, None), (D2, 0, "DJ Moore Jr.", None, 4, "WR")])
    players = spark.createDataFrame(
        [("1", "DJ Moore", "WR"), ("2", "Josh Allen", "QB"), ("3", "Josh Allen", "QB"), ("4", "Josh Allen", "LB")],
        "player_id STRING, name STRING, position STRING",
    )
    got = {(r.name, r.snapshot_date): r.player_id for r in market.match_names(df, players).collect()}
    assert got == {("D.J. Moore", D1): "1", ("Josh Allen", D1): None, ("Nobody", D1): None, ("DJ Moore Jr.", D2): "1"}


def block(name, team="", value="1,234", pos="WR1"):
    return (
        f'<div class="onePlayer" data-x="1"><div class="player-name"><p class="n"><a href="/p"> {name} </a></p>'
        f'<span class="player-team">{team}</span></div><div class="position-team"><p class="position">{pos}</p></div>'
        f'<div class="value"><p> {value} </p></div></div>'
    )


def test_listing_blocks(spark):
    html = (
        "<html><body><div class='nav'>x</div>" + block("A &amp; B", "SF") + block("", "KC") + block("C", "", "")
        + block("D", " NE ", "7", "kc RB") + block("E", "", "n/a") + block("F", "", "12", "RDP") + "</body></html>"
    )
    df = spark.createDataFrame([(0, html), (1, "<html>none</html>")], "page INT, html STRING")
    rows = [tuple(r) for r in listing.listing_rows(df).orderBy("pos").collect()]
    assert rows == [(0, 0, "A & B", "SF", 1234, "WR"), (0, 3, "D", "NE", 7, "K"), (0, 5, "F", None, 12, None)]


def crawl(spark, pages, **kwargs):
    rows = [(p, i, n, t) for p, names in pages.items() for i, (n, t) in enumerate(names)]
    df = spark.createDataFrame(rows, "page INT, pos INT, name STRING, team STRING")
    kept = listing.crawl_cutoff(df, **kwargs)
    return Counter((r.page, r.name, r.team) for r in kept.collect())


def walk(pages, page_rows, max_pages=99):
    """Reads the pages one by one; a missing team and the text "null" are the same key."""
    seen, kept = set(), []
    for number in range(max_pages):
        names = pages.get(number, [])
        before = len(seen)
        for name, team in names:
            key = (name, team or "null")
            if key not in seen:
                seen.add(key)
                kept.append((number, name, team))
        if len(names) < page_rows or len(seen) == before:
            break
    return Counter(kept)


def test_crawl_end(spark):
    full = {p: [(f"n{p}-{i}", None) for i in range(4)] for p in range(12)}
    short = {**full, 3: full[3][:2]}
    repeat = {**full, 2: full[1]}
    gap = {p: rows for p, rows in full.items() if p != 5}
    headless = {p: rows for p, rows in full.items() if p}
    doubled = {0: [("a", None), ("a", "null"), ("a", "X"), ("b", None)], 1: full[1]}
    for pages in (full, short, repeat, gap, headless, doubled):
        assert crawl(spark, pages, page_rows=4) == walk(pages, 4)
        assert crawl(spark, pages, page_rows=4, max_pages=10) == walk(pages, 4, 10)


def test_crawls_are_kept_apart(spark):
    rows = [("x", p, i, f"n{p}{i}", None) for p in range(3) for i in range(2)] + [("y", 0, 0, "n00", None)]
    df = spark.createDataFrame(rows, "day STRING, page INT, pos INT, name STRING, team STRING")
    kept = listing.crawl_cutoff(df, by=["day"], page_rows=2)
    assert Counter(r.day for r in kept.collect()) == {"x": 6, "y": 1}


def test_item_links(spark):
    df = spark.createDataFrame([(1, '<ul><li><a href="/a">A</a></li><li><a href="">B</a></li><li><a href="/c">C</a></li></ul>')], "page_id INT, html STRING")
    assert [tuple(r) for r in listing.link_rows(df).orderBy("pos").collect()] == [(1, 0, "/a", "A"), (1, 2, "/c", "C")]


def test_listing_quotes_and_entities(spark):
    def block(cls, name):
        return (
            f"<div {cls}><div class='player-name'><p><a href=x>{name}</a></p></div><div class=\"player-team\">SF</div>"
            "<div class=value><p>1,234</p></div><p class='position-team x'>RB1</p></div>"
        )

    html = (
        block("class='onePlayer a'", "D&#x27;Andre &amp;amp; Swift&nbsp;")
        + block("class=onePlayer", "Ren&eacute; &#8217;x&bogus;&#xD800;")
        + block('id="1" class="a onePlayer"', "Plain &lt;&#39;&gt;")
        + block("class=onePlayerX", "Other class")
    )
    rows = listing.listing_rows(spark.createDataFrame([(0, html)], "page INT, html STRING"))
    assert [r.name for r in rows.orderBy("pos").collect()] == ["D'Andre &amp; Swift", "René ’x&bogus;&#xD800;", "Plain <'>"]


def test_landed_pages_are_not_capped(spark):
    rows = spark.createDataFrame([(p, 0, f"n{p}", None) for p in range(15)], "page INT, pos INT, name STRING, team STRING")
    assert listing.crawl_cutoff(rows, page_rows=1).count() == 15
    assert listing.crawl_cutoff(rows, page_rows=1, max_pages=10).count() == 10


def test_a_field_ends_at_its_own_closing_tag(spark):
    def text(html, cls="f", *path):
        df = spark.createDataFrame([(html,)], "html STRING")
        slow = listing.field_html(listing.tokens(F.col("html")), cls, *path)
        got = df.select(listing._plain(slow).alias("slow"), listing._plain(listing._field(F.col("html"), cls, *path)).alias("t")).first()
        assert got.slow == got.t
        return got.t

    assert text('<div class="f">a<div>b<div>c</div></div>d</div>e') == "abcd"
    assert text('<DIV class="f">a<div>b</DIV>c<br><img/>d</div>e') == "abcd"
    assert text('<p class="f">a<p>b</p>') == "a"
    assert text('<div class="f"><span>x</span><p>a <i>b</i></p><p>c</p></div>', "f", "p") == "a b"
    assert text('<div class="f"></div><p>a</p>', "f", "p") == ""
    assert text('<div class="g">a</div>') == "" and text("") == "" and text('<div class="f">never closed <b>x') == "never closed x"
    assert text('<div class="f"><a>1</a></div><div class="f"><a>2</a></div>', "f", "a") == "1"
    assert text('<div class="f"><!-- </div> -->a<input></div>b') == "a"


def test_digest_is_that_of_the_flat_array_or_of_a_tree_of_it(spark):
    rows = [(D1, i, f"n{i % 90:02d}", None if i % 3 else "SF", i % 7, "QB") for i in range(137)] + [(D2, 0, "a", None, None, None)]
    texts = sorted((r[2], json.dumps({k: v for k, v in zip(("name", "position", "team", "value"), (r[2], r[5], r[3], r[4])) if v is not None}, separators=(",", ":"))) for r in rows[:137])
    texts = [t for _, t in texts]

    def sha(text):
        return sha256(text.encode()).hexdigest()

    def tree(digests, k):
        while len(digests) > 1:
            digests = [sha("".join(digests[i : i + k])) for i in range(0, len(digests), k)]
        return digests[0]

    for leaf in (1000, 137, 50, 6):
        for parts in (1, 7):
            got = {r.snapshot_date: (r.n, r.digest) for r in market.content_digests(frame(spark, rows).repartition(parts), leaf).collect()}
            leaves = [sha("[" + ",".join(texts[i : i + leaf]) + "]") for i in range(0, 137, leaf)]
            assert got == {D1: (137, tree(leaves, leaf)), D2: (1, sha('[{"name":"a"}]'))}
    assert market.content_digests(frame(spark, [])).collect() == []


def test_ranks_are_dense_over_partitions(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.adaptive.enabled", "false")
    session.conf.set("spark.sql.shuffle.partitions", "9")
    df = session.range(5000).selectExpr("IF(id % 3 = 0, 0, id % 11) AS g", "abs(xxhash64(id)) AS o")
    got = dense_ranks(df, ["g"], ["o"])
    plain = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("o")) - 1)
    assert sorted(map(tuple, got.select("g", "o", "rank").collect())) == sorted(map(tuple, plain.collect()))


def test_pattern_and_tokens_agree(spark):
    """Random markup; a field by the pattern, where it is sure, is the field by the tokens."""
    rng = random.Random(4)
    tags = ("div", "p", "a", "span")

    def markup(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(("x", "y 1", "", "<br>", "<!-- </div> -->", "<p>", "</a>", "<a/>", "&amp;"))
        tag = rng.choice(tags)
        cls = rng.choice(("", ' class="f"', " class='g f'", " class=f", ' id="f"'))
        close = "" if rng.random() < 0.1 else f"</{tag if rng.random() < 0.9 else tag.upper()}>"
        return f"<{tag}{cls}>" + "".join(markup(depth - 1) for _ in range(rng.randint(0, 3))) + close

    df = spark.createDataFrame([("".join(markup(4) for _ in range(3)),) for _ in range(1500)], "html STRING").repartition(4)
    for path in ((), ("p",), ("p", "a"), ("div",)):
        both = df.select("html", listing._field(F.col("html"), "f", *path).alias("fast"), listing.field_html(listing.tokens(F.col("html")), "f", *path).alias("slow"))
        assert both.filter("slow <> ''").count() > 50
        assert both.filter("NOT fast <=> slow").collect() == []


def test_nested_fields_need_no_fold(spark, monkeypatch):
    """Elements of a field's own name, comments and paths that end early are decided by the pattern."""
    monkeypatch.setattr(listing, "field_html", lambda *_: F.lit("fold"))

    def text(html, *path):
        return spark.createDataFrame([(html,)], "html STRING").select(listing._field(F.col("html"), "f", *path)).first()[0]

    assert text('<div class="f">a<div>b<div>c</div></div>d</div>e') == "a<div>b<div>c</div></div>d"
    assert text('<div class="f"><!-- </div> -->a<br></div>b') == "a<br>"
    assert text('<div class="f"><div><div>up</div></div><p>7<p>9</p></p></div>', "p") == "7"
    assert text('<div class="f"><div><b>#</b></div><p></p></div><div><p><a>x</a></p></div>', "p", "a") == ""
    assert text('<div class="f"><div><p><a><span>x</span> <!-- <a> -->y</a></p></div></div>', "p", "a") == "<span>x</span> y"
    assert text('<div class="g">a</div>') == "" and text('<div class="f">open <b>x') == "open <b>x"
    deep = "<div>" * listing.NESTED + "x" + "</div>" * listing.NESTED
    assert text(f'<div class="f">{deep}</div>') == deep and text(f'<div class="f"><div>{deep}</div></div>') == "fold"
    long = "<div>x <i>y</i></div>" * 40000
    assert text(f'<b>{long}</b><div class="f">{long}<p>{long}</p></div>') == f"{long}<p>{long}</p>"


def test_pattern_and_tokens_agree_on_odd_markup(spark):
    """Tags in attributes, loose signs, several classes, elements deeper than the pattern goes."""
    rng = random.Random(9)
    odd = ("x", " ", "<br>", "<BR class=f>", "<!-- </div> -->", "<!--", "-->", "<p>", "</p>", "<a/>", "</div/>", "<", "< b>", "<>", "<pre>")
    odd += ('<div class="f', '<a title="<!--">', "<div\n class='f'>", '<img class="f"/>', "<!-->", "</div >")
    classes = (' class="f"', ' class = "g\tf h"', ' class="ff"', " class=f-g", ' data-class="f"', ' class="g" class="f"', ' class=f"x', ' class="a>b f"', ' CLASS="f"', ' class="')

    def markup(depth):
        if depth == 0 or rng.random() < 0.25:
            return rng.choice(odd)
        tag = rng.choice(("div", "p", "a", "DIV", "p-x"))
        close = "" if rng.random() < 0.1 else f"</{tag}>"
        return f"<{tag}{rng.choice(classes) if rng.random() < 0.35 else ''}>" + "".join(markup(depth - 1) for _ in range(rng.randint(0, 3))) + close

    def chain():
        tag, n = rng.choice(("div", "p", "a")), rng.randint(1, 9)
        return f"<{tag} class=f>" + "".join(f"<{tag}>{rng.choice(odd)}" for _ in range(n)) + "<p>in<a>" + f"</{tag}>x" * rng.randint(0, n + 1)

    rows = [("".join(markup(5) if rng.random() < 0.8 else chain() for _ in range(2)),) for _ in range(2500)]
    rows.append(("<p class=f><p>" + "<a>" * 7 + "in</a></p>",))
    df = spark.createDataFrame(rows, "html STRING").repartition(4)
    for path in ((), ("p", "a"), ("div", "div")):
        both = df.select("html", listing._field(F.col("html"), "f", *path).alias("fast"), listing.field_html(listing.tokens(F.col("html")), "f", *path).alias("slow"))
        assert both.filter("slow <> ''").count() > 50
        assert both.filter("NOT fast <=> slow").collect() == []
