import base64
import gzip
import hashlib
import random

import pyarrow.fs as fs
import pytest

from textpulse.llm import html, warc
from textpulse.llm.html import blocks, extract_main_text, main_text, op3_main_text
from textpulse.llm.store import new_folder, opened

BODY = "<p>First things, said at length; with marks, and more of them.</p><p>Second &amp; last,\n of <b>many</b> words, too.<br>Ends here.</p>"
WANT = "First things, said at length; with marks, and more of them.\nSecond & last, of many words, too. Ends here."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("<html><body></body></html>", ""),
        ("<p></p><!-- <p>none</p> -->", ""),
        (f"<body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article>{BODY}</article><footer>&copy; us.</footer></body>", WANT),
        (f"<div class='top menu'><a href=x>a</a> <a href=y>b</a></div><div id=main>{BODY}</div><div class='comments'><p>I, too, say so, at length, here, now.</p></div>", WANT),
        (f"<script>var a = '</p><p>not text</p>';</script><style>p{{}}</style>{BODY}<form><p>Mail, name, and so on, please.</p><input></form>", WANT),
        (f"<aside>On the side, told at some length, with marks.</aside><main>{BODY}</main><div class=cookie-notice>We use these, and those, too.</div>", WANT),
        (f"<ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul><div>{BODY}</div>", WANT),
        ("<article><h1>Title</h1><p><b>Bold and unclosed, with marks.<br><p>Next one, here, of words.</p></article>", "Title\nBold and unclosed, with marks.\nNext one, here, of words."),
        ("plain text, no tags &lt;at all&gt;", "plain text, no tags <at all>"),
        ("<p>a &#233; &eacute; &nbsp; b &unknown; &am</p>", "a é é b &unknown; &am"),
        ("<P CLASS=x>Upper case, and <I>inline</I>.</P", "Upper case, and inline."),
    ],
)
def test_the_article_is_what_stays(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize(
    "page",
    [
        f"<body class='has-sidebar'><nav><a href=x>Home</a></nav><article>{BODY}</article></body>",
        f"<main id='search-results'>{BODY}</main>",
        f"<article class='post comment-open'>{BODY}</article>",
        f"<div class='social-content'>{BODY}</div>",
        f"<div class='ad-free-content'>{BODY}</div>",
        f"<form id=all>{BODY}</form>",
        f"<article><svg width='1'/>{BODY}</article>",
        f"<article><object data=x><select><option>one</select></object>{BODY}</article>",
        f"<div><audio src=x></div><article>{BODY}</article>",
        f"<article>{BODY}</article><svg><path d='M0'><g><text>drawn</text></svg>",
    ],
)
def test_names_and_foreign_elements_take_no_article(page):
    assert main_text(page) == WANT


def test_what_is_hidden_ends_no_block():
    assert main_text("<p>Of <math><mi>x</mi></math> and <svg><path/>no</svg>y, it says.</p>") == "Of x and y, it says."


WORDS = [w + v for w in "mor len tas vi oru del ban esk".split() for v in ("", "a", "in", "eth", "o")]


def sentence(rng, low=6, high=18):
    words = [rng.choice(WORDS) for _ in range(rng.randint(low, high))]
    if rng.random() < 0.4:
        words[len(words) // 2] += ","
    return " ".join(words).capitalize() + "."


def planted_page(rng):
    """A page without telling names, tags or roles, and the blocks of its article."""
    wanted = []

    def put(tag, text):
        wanted.append(text)
        return f"<{tag}>{text}</{tag}>"

    def prose(n):
        return " ".join(sentence(rng) for _ in range(n))

    links = "".join(f"<li><a href='/{k}'>{rng.choice(WORDS)} {rng.choice(WORDS)}</a></li>" for k in range(rng.randint(4, 9)))
    body = [put("h1", sentence(rng, 4, 8))]
    for _ in range(rng.randint(4, 12)):
        kind = rng.random()
        if kind < 0.7:
            body.append(put("p", prose(rng.randint(1, 5))))
        elif kind < 0.8:
            body.append(put("h2", sentence(rng, 2, 5)) + put("p", prose(3)))
        elif kind < 0.9:
            body.append("<ul>" + "".join(put("li", sentence(rng, 3, 7)) for _ in range(rng.randint(2, 5))) + "</ul>")
        else:
            body.append(f"<blockquote>{put('p', prose(1))}</blockquote>")
    body.append(put("p", prose(3)))
    wrap = rng.choice(["<div>{}</div>", "<div class='x1'><div>{}</div></div>", "<section>{}</section>", "<table><tr><td>{}</td></tr></table>", "<main>{}</main>", "<article>{}</article>"])
    notice = f"<div class='box'><p>{prose(rng.randint(1, 2))}</p></div>" if rng.random() < 0.7 else ""
    teasers = "".join(f"<div class='k'><div><a href='/t'>{sentence(rng, 3, 6)}</a></div><p>{sentence(rng)}</p></div>" for _ in range(rng.randint(0, 4)))
    comments = "".join(f"<div class='c'><div><a href='/u'>{rng.choice(WORDS)}</a></div><p>{prose(rng.randint(1, 2))}</p></div>" for _ in range(rng.randint(0, 8)))
    page = f"<html><head><title>{rng.choice(WORDS)}</title></head><body><div><ul>{links}</ul></div>{notice}{wrap.format(''.join(body))}"
    page += f"<div>{teasers}</div><div class='thread'>{comments}</div><div><p>{sentence(rng, 3, 6)}</p><ul>{links}</ul></div></body></html>"
    return page, wanted


def block_scores(seed=5, pages=300):
    rng, right, got, want = random.Random(seed), 0, 0, 0
    for _ in range(pages):
        page, wanted = planted_page(rng)
        found = main_text(page).split("\n")
        right += sum(t in wanted for t in found)
        got += len(found)
        want += len(wanted)
    return right / got, right / want


def test_planted_articles_are_found_by_their_paths(monkeypatch):
    precision, recall = block_scores()
    assert precision >= 0.95 and recall >= 0.95
    monkeypatch.setattr(html, "content", lambda found: [True] * len(found))
    assert block_scores()[0] < 0.8


def test_paths_name_tags_and_classes():
    found, elements = blocks("<div class='a b'><p>x</p>y</div><div class='a b'>z</div>")
    assert [(e.tag, e.words) for e in elements[1:]] == [("div", ("a", "b")), ("p", ()), ("div", ("a", "b"))]
    assert [b.element.path for b in found] == [2, 1, 1]
    assert len(blocks("<p>" * 3000 + "x")[0]) == 1 and len(main_text("<div>" * 3000 + BODY * 3)) > 100


def test_rows_keep_their_columns(spark, small):
    pages = spark.createDataFrame([(1, None, 3), (None, BODY, None), (1, BODY, 4), (2, f"<article>{BODY * 2000}</article>", 5)], "page_id long, html string, text int")
    got = extract_main_text(pages).collect()
    assert [r.main_text for r in got][:3] == ["", WANT, WANT] and got[3].main_text == "\n".join([WANT] * 2000) and [r.text for r in got] == [3, None, 4, 5]
    assert extract_main_text(pages.limit(0)).count() == 0
    out = op3_main_text(spark, small)
    assert out.columns == ["page_id", "url", "text", "n_chars"] and out.filter("n_chars != length(text)").count() == 0


# --- archives -----------------------------------------------------------------------------------

LONG = "long é " * 5000
PAGES = [
    (5, "http://a/ b\n", "same", "x"), (3, None, "same", "y"), (9, "http://c", "same", "z"), (1, "http://d", None, None), (2, "http://e", "", "q"),
    (4, "http://f", LONG, "r"), (6, "http://g", LONG, "s"), (None, "http://h", "same", "t"), (None, "http://i", "own", "u"), (5, "http://a", "same", "x"),
    (7, "http://j", "a\r\n\r\nb WARC/1.1\r\n", "v"),
]


def archived(spark, rows, revisit_from=0, size=1000):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record string")
    folder = new_folder(spark, "test-warc")
    chunks = warc.chunk_table(pages, size=size)
    archives = warc.write_archives(chunks, warc.plan_records(chunks, revisit_from), folder)
    return chunks, folder, archives, warc.read_archives(archives, folder).collect()


def test_archives_give_back_every_record(spark):
    chunks, folder, archives, got = archived(spark, PAGES)
    assert chunks.filter("length(data) > 1000").count() == 0
    payload = {}
    for page, _, html, _ in PAGES:
        payload.setdefault(html or "", []).append(page)
    want = []
    for html, ids in payload.items():
        body = html.encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        order = sorted(ids, key=lambda i: (i is None, i or 0))
        want += [(i, len(body), digest, "revisit" if k else "response", order[0] if k else None) for k, i in enumerate(order)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_archives_are_plain_gzip_members(spark):
    _, folder, archives, _ = archived(spark, PAGES)
    system, path = opened(folder)
    named = {r.file for r in archives.collect()}
    assert {f.base_name for f in system.get_file_info(fs.FileSelector(path))} == named
    text = b"".join(gzip.decompress(system.open_input_file(f"{path}/{n}").read()) for n in sorted(named))
    assert text.count(b"WARC/1.1\r\nWARC-Type: ") == len(PAGES) and text.count(LONG.encode()) == 1
    assert b"WARC-Target-URI: http://a/%20b%0A\r\n" in text


def test_short_payloads_are_all_responses(spark):
    got = archived(spark, PAGES, revisit_from=100)[3]
    assert sum(r.record_type == "revisit" for r in got) == 1


def test_a_hot_payload(spark):
    got = archived(spark, [(k, "u", "hot" if k % 3 else f"own {k}", "") for k in range(3000)])[3]
    assert sum(r.record_type == "revisit" for r in got) == 1999 and {r.refers_to for r in got if r.refers_to is not None} == {1}


def test_chunks_of_a_large_record_stay_together(spark):
    low = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
    }
    kept = {k: spark.conf.get(k) for k in low}
    try:
        for k, v in low.items():
            spark.conf.set(k, v)
        large = "".join(hashlib.sha256(bytes([k % 256, k // 256])).hexdigest() for k in range(8000))
        pages = spark.createDataFrame([(1, "u", large), *((k, "u", f"own {k}") for k in range(2, 200))], "page_id long, url string, html string")
        chunks = warc.stage(warc.chunk_table(pages, size=1000).repartition(8), "spread-chunks")
        folder = new_folder(spark, "test-warc")
        archives = warc.write_archives(chunks, warc.plan_records(chunks), folder)
        got = {r.page_id: r.payload_bytes for r in warc.read_archives(archives, folder).collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert got == {1: len(large)} | {k: len(f"own {k}") for k in range(2, 200)}


def test_no_pages(spark):
    assert archived(spark, [])[3] == []
