"""Dialogues, pages and URL lists."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from deskgauge.llm import chat_rotation, url_lists, wrapper_extraction as W
from llm import samples

TURNS = "conv_id bigint, turn bigint, role string, text string"


# -------------------------------------------------------------------- perspectives

def plain_rotation(rows):
    dialogues = {}
    for conv, turn, role, text in rows:
        dialogues.setdefault(conv, {}).setdefault((turn, role, text or ""), 0)
        dialogues[conv][turn, role, text or ""] += 1
    out = []
    for conv, messages in dialogues.items():
        # Within a turn and role the order is a hash: tests keep one text there.
        order = sorted(messages, key=lambda m: (m[0] is None, m[0] or 0, m[1] is None, m[1] or ""))
        for side in {r for _, r, _ in messages if r not in (None, "system")}:
            at = 0
            for position, (turn, role, text) in enumerate(order):
                shown = ("assistant" if role == side else "system" if role == "system" else "user")
                name = ("unknown" if role is None else role) if shown == "user" else None
                head = f"<|im_start|>{shown}" + (f" name={name}" if name is not None else "") + "\n"
                segment = f"{head}{text}<|im_end|>\n"
                mask = ((at + len(head), at + len(segment) - 1) if role == side else (at, at))
                out.append((conv, side, position, turn, shown, name, segment,
                            messages[turn, role, text], at, role == side, *mask))
                at += len(segment)
    return sorted(out, key=repr)


def test_rotation(spark, conf):
    conf("spark.sql.shuffle.partitions", "3")
    rows = [(1, 0, "system", "be brief"), (1, 1, "ann", "hi é😀"), (1, 2, "bob", None), (1, 3, "cyd", ""),
            (1, 4, "ann", "bye"), (1, 4, "ann", "bye"), (2, 0, "ann", "alone"), (3, 0, "system", "no one"),
            (None, 0, "x", "lost"), (None, None, None, "who"), (4, None, "a", "t"), (4, 1, "b", "u"),
            (5, 0, None, "nobody"), (5, 1, "", "empty name"), (5, 2, "z", "z")]
    rows += [(9, t, ("u", "v", "w")[t % 3], "x" * (t % 7)) for t in range(300)]
    frame = spark.createDataFrame(rows, TURNS).withColumns({"side": F.lit(1), "segment": F.lit("s")})
    found = chat_rotation.rotate(frame.repartition(4))
    assert samples.rows(found) == plain_rotation(rows)
    assert chat_rotation.rotate(frame.limit(0)).count() == 0


def test_ties_have_one_order(spark):
    rows = [(1, 0, r, f"text {i}") for i in range(40) for r in ("a", "b")]
    found = [samples.rows(chat_rotation.rotate(spark.createDataFrame(rows, TURNS).repartition(k)))
             for k in (1, 5)]
    assert found[0] == found[1]
    for side in ("a", "b"):
        mine = sorted(r[2:] for r in found[0] if r[1] == side)
        assert [r[0] for r in mine] == list(range(80))
        ends = [r[6] + len(r[4]) for r in mine]
        assert [r[6] for r in mine] == [0, *ends[:-1]]


def test_no_python_in_the_rotation(spark):
    frame = spark.createDataFrame([(1, 0, "a", "t")], TURNS)
    plan = chat_rotation.rotate(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


# ---------------------------------------------------------------------- URL lists

ENTRIES = "list string, allows boolean, kind string, pattern string, adds boolean, at timestamp_ntz"
CAPTURES = "page_id bigint, url string, fetched_at timestamp_ntz"
DAY = dt.timedelta(days=1)
T0 = dt.datetime(2024, 1, 20)


def matches(kind, pattern, url):
    from urllib.parse import urlsplit
    parts = urlsplit(url)
    host = (parts.netloc.rsplit("@")[-1].split(":")[0]).lower()
    if not parts.scheme or not host:
        return False
    if kind == "host":
        return host == pattern
    if kind == "domain":
        return host == pattern or host.endswith("." + pattern)
    path = (host + parts.path).lower().rstrip("/")
    return kind == "prefix" and (path + "/").startswith(pattern + "/") and path != host


def plain_filter(entries, captures):
    out = []
    for page, url, at in captures:
        state = {}
        for name, allows, kind, pattern, adds, since in sorted(
                (e for e in entries if None not in (e[0], e[2], e[3], e[5])),
                key=lambda e: (e[5], bool(e[4]))):
            if at is not None and url and since <= at and matches(kind, pattern.lower(), url):
                state[name, bool(allows), kind, pattern.lower()] = bool(adds)
        active = [k for k, v in state.items() if v]
        block = max((len(k[3]) for k in active if not k[1]), default=0)
        allow = max((len(k[3]) for k in active if k[1]), default=0)
        out.append((page, url, at, ",".join(sorted({k[0] for k in active})), len(active), block > allow))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def web():
    rnd = random.Random(6)
    hosts = ["a.example.com", "b.a.example.com", "example.com", "evil.org", "x.evil.org"]
    entries = [("l1", False, rnd.choice(("host", "domain")), rnd.choice(hosts), rnd.random() < 0.6,
                T0 + DAY * rnd.randrange(200)) for _ in range(150)]
    entries += [("ok", True, "prefix", rnd.choice(hosts) + rnd.choice(("/en", "/en/a", "/b")),
                 rnd.random() < 0.7, T0 + DAY * rnd.randrange(200)) for _ in range(80)]
    entries += entries[:5] + [(None, False, "host", "evil.org", True, T0), ("l1", None, "host", "EVIL.org", True, T0),
                              ("l1", False, "host", None, True, T0), ("l2", False, "domain", "org", None, T0),
                              ("l2", False, "domain", "com", True, T0 + 190 * DAY)]
    urls = ["https://{}/en/a/1?q#f", "http://{}/b/", "https://{}", "http://u:p@{}:80/en", "HTTP://{}/EN/x"]
    captures = [(i, rnd.choice(urls).format(rnd.choice(hosts)), T0 + DAY * rnd.randrange(-20, 230))
                for i in range(200)]
    captures += captures[:3] + [(None, urls[0].format(hosts[0]), T0 + 50 * DAY), (7, None, T0), (8, "", T0),
                                (9, "not a url", T0), (10, urls[0].format("evil.org"), None)]
    return entries, captures


def test_captures_as_of_their_fetch(spark, web):
    entries, captures = web
    valid = url_lists.intervals(spark.createDataFrame(entries, ENTRIES).repartition(3))
    frame = spark.createDataFrame(captures, CAPTURES).withColumns({"row": F.lit(1), "key": F.lit("k")})
    assert samples.rows(url_lists.filter_captures(frame, valid)) == plain_filter(entries, captures)
    none = url_lists.filter_captures(frame, valid.limit(0))
    assert none.filter("blocked").count() == 0 and none.count() == len(captures)
    assert url_lists.filter_captures(frame.limit(0), valid).count() == 0


@pytest.mark.parametrize("late", [dt.datetime(2031, 1, 1), dt.datetime(9999, 12, 31), dt.datetime(1, 1, 2)])
def test_one_far_capture_changes_nothing_for_the_others(spark, web, late):
    entries, captures = web
    captures = [*captures, (2**62, "https://evil.org/en", late), (-2**63, "https://evil.org", late)]
    valid = url_lists.intervals(spark.createDataFrame(entries, ENTRIES))
    frame = spark.createDataFrame(captures, CAPTURES)
    assert samples.rows(url_lists.filter_captures(frame, valid)) == plain_filter(entries, captures)


@pytest.mark.parametrize("first, last", [(0, 0), (-5, 40), (31, 32), (3, 5000), (-70_000, 90_001), (640, 1663)])
def test_periods_make_up_the_whole(spark, first, last):
    levels = url_lists.levels_of(first, last)
    row = spark.range(1).select(url_lists.periods(F.lit(first), F.lit(last), levels).alias("p")).first()
    covered = [n for r in row["p"] for n in range(r["number"] << 5 * r["level"], (r["number"] + 1) << 5 * r["level"])]
    assert sorted(covered) == list(range(first, last + 1)) and len(row["p"]) <= 62 * levels + 2


def test_captures_of_any_id(spark):
    ids = [2**62, -2**63, 2**63 - 1, None, -1, 12]
    pages = spark.createDataFrame([(i, "https://" + "a." * 40 + "org/" + "x/" * 3000) for i in ids], CAPTURES.rsplit(",", 1)[0])
    found = url_lists.captures_of(pages).collect()
    assert [(r["fetched_at"] - dt.datetime(2024, 1, 1)) // dt.timedelta(minutes=1) for r in found
            if r["page_id"] is not None] == [i * 7919 % 525_600 for i in ids if i is not None]
    valid = url_lists.intervals(url_lists.lists_of(pages))
    assert url_lists.filter_captures(url_lists.captures_of(pages), valid).count() == len(ids)


def test_intervals(spark):
    e = lambda day, adds, pattern="p.org": ("l", False, "host", pattern, adds, T0 + day * DAY)
    entries = [e(0, False), e(1, True), e(1, False), e(2, True), e(40, True), e(90, False), e(95, False),
               e(95.5, True), e(3, True, "q.org"), e(200, False, "q.org")]
    found = samples.rows(url_lists.intervals(spark.createDataFrame(entries, ENTRIES)),
                         "pattern", "valid_from", "valid_to")
    assert found == sorted([("p.org", T0 + DAY, T0 + 90 * DAY), ("p.org", T0 + 95.5 * DAY, None),
                            ("q.org", T0 + 3 * DAY, T0 + 200 * DAY)], key=repr)


# ----------------------------------------------------------------- page extraction

PAGES = "page_id bigint, url string, html string"
ARTICLE = ("<html><body><nav><ul><li><a>n{i}</a></li><li><a>m</a></ul></nav><div class='ad'>buy {i}</div>"
           "{open}<h1>Title {i}</h1><p>First &amp; <b>bo</b>ld&nbsp;{i}<br>line<p>{more}</p>{close}"
           "<div class='comments'><p>reader {i}</p></div><form><p>mail<input></form>"
           "<script>var x = '</p>{i}';</script><!-- c {i} --><footer>foot {i}")


@pytest.mark.parametrize("opening, closing", [
    ("<article>", "</article>"), ("<main>", "</main>"), ("<div id='post-content'>", "</div>"),
    ("<div>", "</div>")])
def test_articles_of_a_host(spark, opening, closing):
    more = "Second part, which has quite a number of words of its own so that it counts. " * 3
    rows = [(i, f"https://h{i % 2}.org/{i}",
             ARTICLE.format(i=i, open=opening, close=closing, more=more + str(i))) for i in range(12)]
    wanted = [(i, u, f"Title {i} First & bold {i} line {more}{i}") for i, u, _ in rows]
    frame = spark.createDataFrame(rows, PAGES).withColumns({"text": F.lit("t"), "main": F.lit("m")})
    for size in (1_000_000, 0):
        found = W.main_text(frame.repartition(5), broadcast_bytes=size)
        assert samples.rows(found) == sorted(((i, u, t, len(t)) for i, u, t in wanted), key=repr)


def test_awkward_pages(spark):
    rows = [(1, None, None), (2, "", ""), (None, "https://a.org", "<p>x"), (4, "https://a.org", "a < b & c"),
            (4, "https://a.org", "a < b & c"), (5, "x", "<div>" * 3000 + "deep" + "</div>" * 3000),
            (6, "x", "<a title='never closed>text <p>y</p>"), (7, "https://a.org", "<script>only"),
            (8, "https://b.org", "<p>" + "word " * 200_000 + "</p>"), (9, "https://b.org", "</p></div></x>z")]
    found = W.main_text(spark.createDataFrame(rows, PAGES))
    texts = {(r["page_id"], r["url"]): r["text"] for r in found.collect()}
    assert found.count() == len(rows) and found.agg(F.sum(F.length("text") - F.col("n_chars"))).first()[0] == 0
    assert texts[1, None] == "" and texts[2, ""] == "" and texts[None, "https://a.org"] == "x"
    assert texts[4, "https://a.org"] == "a < b & c" and texts[5, "x"] == "deep"
    assert texts[8, "https://b.org"] == ("word " * 200_000).strip() and texts[9, "https://b.org"] == "z"
    assert W.main_text(spark.createDataFrame([], PAGES)).count() == 0


def test_wrappers_are_union_free():
    pages = ["<ul><li>a<li>b</ul><p>x</p>", "<ul><li>a</ul><p>x</p><hr><div>d</div>", "<p>x <b>y</b></p>"]
    wrapper = None
    for page in pages:
        own = W.page_wrapper(W.parse(page))
        wrapper = own if wrapper is None else W._aligned(wrapper, own)
    assert W.expression(wrapper) == "(<ul>(<li>#</li>)+</ul>)?<p>#(<b>#</b>)?</p>(<div>#</div>)?"


def test_wrappers_do_not_grow_with_the_pages():
    rnd = random.Random(8)
    wrapper = None
    for _ in range(300):
        page = "".join(rnd.choice(("<p>x</p>", "<div>y</div>", "<h2>z</h2>", "<table><tr><td>t</table>"))
                       for _ in range(rnd.randint(1, 200)))
        own = W.page_wrapper(W.parse(page))
        wrapper = own if wrapper is None else W._aligned(wrapper, own)
    assert len(W.expression(wrapper)) < 20_000


@pytest.mark.parametrize("page, wanted", [
    ("<article>" + "<div>" * 60 + "deep" + "</div>" * 60 + "<p>rest of it</p></article>", "deep rest of it"),
    ("<div><article>" + "<div>" * 60 + "a" + "</div>" * 60 + "<div>b</div></article></div>", "a b"),
    ("<article>" + "<div>" * 60 + "<nav>menu</nav>a" + "</div>" * 60 + "</article>", "a"),
    ("<div data-x='" + "{\"a\": \"b>c\"}" * 2000 + "' class='ad'>buy</div><p>text</p>", "text"),
    ("<div title=\"x\"\">kept <p title='y'>too</p></div>", "kept too"),
    ("<article>a <svg viewBox='0'/> b <p>c</p></article>", "a b c"),
    ("<article>a <svg><path d='1'> <p>b</p> c</article>", "a b c"),
    ("<article>a <svg><title/><text>axis</text></svg> b <object>c</object></article>", "a b c")])
def test_nothing_is_lost_in_the_parser(page, wanted):
    assert W.extract(page, None) == wanted


BIG, FURTHER = "Many words of the long first part. " * 20, "A further part by itself. " * 5


@pytest.mark.parametrize("page, wanted", [
    ("<main><article>{big}</article><section>{further}</section></main>", "{big} {further}"),
    ("<body><p>{further}</p><div>{big}</div></body>", "{further} {big}"),
    ("<div class='entry-content'>{big}</div><section class='post-body'>{further}</section>", "{big} {further}")])
def test_parts_side_by_side(spark, page, wanted):
    rows = [(i, f"https://h.org/{i}", page.format(big=f"{i} {BIG}", further=f"{i} {FURTHER}"))
            for i in range(6)]
    teaser = "<div class='entry-content'>teaser of nine</div><div><p>9 " + BIG + "</p></div>"
    found = W.main_text(spark.createDataFrame([*rows, (9, "https://h.org/9", teaser)], PAGES))
    texts = {r["page_id"]: r["text"] for r in found.collect()}
    assert texts.pop(9) == f"teaser of nine 9 {BIG}".strip()
    assert texts == {i: " ".join(wanted.format(big=f"{i} {BIG}", further=f"{i} {FURTHER}").split())
                     for i in range(6)}


@pytest.mark.parametrize("page", [
    "<article class='post comments-open'>{t}</article>", "<main class='with-sidebar'>{t}</main>",
    "<div class='content overflow-hidden'>{t}</div>", "<section id='related-work'>{t}</section>",
    "<p><a href='/hidden-gems' title='a hidden gem'>{t}</a></p>", "<p data-id='ad' data-role=menu>{t}</p>",
    "<p><a href='?id=ad&class=menu'>{t}</a></p>", "<div class='related'><main>{t}</main></div>",
    "<div class='notice'><div>{t}</div></div>", "<div class='widget'><article>{t}</article></div><p>{t}</p>"])
def test_class_words_hide_no_article(page):
    text = "All that the article says."
    wanted = f"{text} {text}" if page.count("{t}") == 2 else text
    assert W.extract(page.format(t=text) + "<div class='ad sidebar-left'></div>") == wanted


def test_class_words_hide_the_rest(spark):
    page = ("<article>{i} an article</article><div class='sidebar-left'>side</div><p hidden>h</p>"
            "<div id=comments><article>a reader</article></div><ul class='related posts'><li>more</ul>")
    assert W.extract(page) == "{i} an article"
    rows = [(i, "https://h.org", f"<p>Top</p><div class='notices'>{i} {BIG}</div>") for i in range(4)]
    found = W.main_text(spark.createDataFrame(rows, PAGES))
    assert all(BIG.strip() in r["text"] for r in found.collect())


def texts_of(spark, rows, parts=3):
    found = W.main_text(spark.createDataFrame(rows, PAGES).repartition(parts))
    return {r["page_id"]: r["text"] for r in found.collect()}


TEMPLATE = ("<div class='top'>Tell your friends</div><div class='main-column'><h1>Title {i}</h1>"
            "<p>Own {i} text</p><p>Serves four people.</p></div>{extra}<div class='end'>Buy <b>now</b></div>")


def test_literals_outside_the_region_are_template(spark):
    rows = [(i, "https://h.org", TEMPLATE.format(i=i, extra="<hr><ul><li>all pages</ul>" * (i % 2)))
            for i in range(7)]
    rows += [(7, "https://h.org", "<table><tr><td>Tell your friends</td></tr></table>")]
    rows += [(i, "https://two.org", "<p>the same</p><p>on two</p>") for i in (8, 9)]
    rows += [(i, "https://copies.org", "<p>a copy</p>") for i in (10, 11, 12, 13)]
    for parts in (1, 4):
        texts = texts_of(spark, rows, parts)
        wanted = {i: f"Title {i} Own {i} text Serves four people." for i in range(7)}
        # The list is on fewer than half of the pages; the table is aligned with nothing.
        for i in (1, 3, 5):
            wanted[i] += " all pages"
        assert texts == wanted | {7: "Tell your friends", 8: "the same on two", 9: "the same on two"} | {
            i: "a copy" for i in (10, 11, 12, 13)}


def test_the_text_comes_through_the_alignment(spark, monkeypatch):
    rows = [(i, "https://h.org", TEMPLATE.format(i=i, extra="")) for i in range(5)]
    wrapper = None
    for _, _, page in rows:
        own = W.page_wrapper(W.parse(page))
        wrapper = own if wrapper is None else W._aligned(wrapper, own)
    assert len(W.main_path(wrapper)) == 1
    page = rows[0][2]
    assert W.extract(page, W.host_final(wrapper)) == "Title 0 Own 0 text Serves four people."
    # Without an alignment, one page for all, nothing is known to be template.
    assert W.extract(page, W.host_final(W.page_wrapper(W.parse(page)))) == (
        "Tell your friends Title 0 Own 0 text Serves four people. Buy now")


def test_articles_keep_what_is_equal_on_all_pages(spark):
    page = ("<p>Site line</p><article><h1>Title {i}</h1><p>Serves four people.</p><p>Own {i}</p>"
            "<div class='tip'>A tip</div></article>")
    texts = texts_of(spark, [(i, "https://h.org", page.format(i=i)) for i in range(5)])
    assert texts == {i: f"Title {i} Serves four people. Own {i} A tip" for i in range(5)}


@pytest.mark.parametrize("page, wanted", [
    ("<form id=aspnet><nav>menu</nav><article>Text</article><input></form>", "Text"),
    ("<form><div>All <p>text</p><select><option>no</select></div></form>", "All text"),
    ("<p>Text</p><form><p>Your mail</p></form>", "Text"),
    ("<article><header><h1>T</h1><p>Lead</p><nav>n</nav></header><p>x</p></article>", "T Lead x"),
    ("<header><h1>Site</h1><p>slogan</p></header><article>x</article>", "x")])
def test_forms_and_headers(page, wanted):
    assert W.extract(page) == wanted
