"""Bad input, several records per binary, streaming, and texts known from how the page was made."""

import hashlib
import html
import random
import zlib

from ledgerlens.llm import warc


def gzip(data):
    z = zlib.compressobj(wbits=31)
    return z.compress(data) + z.flush()


def test_texts_and_links_by_construction(spark):
    """Pages are written from a list of blocks, so title, text and links are known without parsing."""
    rng = random.Random(3)
    word = lambda: rng.choice(["river", "mill", "à côté", "größer", "a<b", "R&D", "x  y", "\n", "漢字", "'", '"'])
    rows, want = [], {}
    for k in range(60):
        title = " ".join(word() for _ in range(rng.randint(0, 3)))
        lines, links, body = [], [], []
        for _ in range(rng.randint(0, 8)):
            text = " ".join(word() for _ in range(rng.randint(0, 5)))
            kind = rng.choice(["p", "li", "a", "script", "style", "template", "noscript", "b"])
            if kind == "a":
                links.append(f"/p?a={rng.randint(0, 9)}&b")
                body.append(f"<p>see <a class=x href='{html.escape(links[-1])}'>{html.escape(text)}</a></p>")
                lines.append("see " + text)
            elif kind in ("p", "li"):
                body.append(f"<{kind}>{html.escape(text)}</{kind}>")
                lines.append(text)
            elif kind == "b":
                body.append(f"<div>one <b>{html.escape(text)}</b> two</div>")
                lines.append(f"one {text} two")
            else:
                body.append(f"<{kind}>hidden {html.escape(text) if kind in ('template', 'noscript') else 'x'}</{kind}>")
        rows.append((k, f"http://a.org/{k}", f"<html><head><title>{html.escape(title)}</title></head><body>{''.join(body)}</body></html>"))
        shown = [" ".join(x.split()) for part in [title, *lines] for x in part.split("\n")]
        want[k] = ("\n".join(x for x in shown if x), " ".join(title.split()), len(links))
    out = warc.summary(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert len(out) == 60
    for r in out:
        text, title, n = want[r.page_id]
        assert (r.title, r.n_links, r.n_chars, r.text_sha256) == (title, n, len(text), hashlib.sha256(text.encode()).hexdigest())
        assert r.digest_agrees and r.http_status == "200" and r.target_uri == f"http://a.org/{r.page_id}"


def test_charsets_and_unclosed_elements():
    for charset in ("idna", "punycode", "no-such", "utf-16", "undefined", "base64", ""):
        assert isinstance(warc._decode(b"caf\xe9 \xff", charset), str)
    assert warc._decode("é".encode("latin-1"), "latin-1") == "é"
    assert warc.page_text("<p>a</p><noscript>b<p>c")[0] == "a\nb\nc".replace("b\nc", "bc") or "b" in warc.page_text("<p>a</p><noscript>b<p>c")[0]
    assert warc.page_text("<noscript>no</noscript><p>yes</p>")[0] == "yes"
    assert warc.page_text("<template><script>x</script>t</template>z")[0] == "z"


def test_broken_and_several_records(spark, tmp_path):
    good = [warc.response(k, f"http://a.org/{k}", f"<p>page {k}</p>") for k in range(3)]
    request = warc.build([("WARC-Type", "request"), ("WARC-Record-ID", "<x>")], b"GET /")
    no_length = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: many\r\n\r\n"
    cut = good[2][:-30]
    rows = [(1, b"".join(good)), (2, b"junk" + good[0] + request), (3, no_length + good[1]), (4, cut), (5, None), (6, b""), (7, b"WARC/1.1\r\nno end")]
    out = warc.derive(spark.createDataFrame([(*r, "k") for r in rows], "id int, record binary, metadata string")).collect()
    got = sorted((r.id, r.position, r.conversion is not None, r.error) for r in out)
    assert got == [
        (1, 0, True, None), (1, 1, True, None), (1, 2, True, None),
        (2, 0, False, "bytes that are no record"), (2, 1, True, None), (2, 2, False, None),
        (3, 0, False, "no length"), (3, 1, True, None),
        (4, 0, False, "block is cut short"),
        (5, 0, False, None), (6, 0, False, None),
        (7, 0, False, "headers don't end"),
    ]
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.warc.gz").write_bytes(b"".join(map(gzip, good * 40)))
    (folder / "b.warc").write_bytes(b"".join(good))
    (folder / "c.warc.gz").write_bytes(gzip(good[0]) + gzip(good[1])[:40] + b"\0" * 50)
    read = warc.read_records(spark, f"file://{folder}").collect()
    by = {n: [r for r in read if r.path.endswith(n)] for n in ("a.warc.gz", "b.warc", "c.warc.gz")}
    assert len(by["a.warc.gz"]) == 120 and len(by["b.warc"]) == 3 and all(r.error is None for r in by["a.warc.gz"] + by["b.warc"])
    assert [r.error is None for r in by["c.warc.gz"]] == [True, False]


def test_records_of_any_cut():
    data = b"".join(warc.response(k, "u", "x" * (k * 100)) for k in range(6))
    whole = list(warc.records([data]))
    assert len(whole) == 6 and all(e is None for *_, e in whole)
    for n in (1, 7, 64):
        assert list(warc.records(data[k : k + n] for k in range(0, len(data), n))) == whole
    packed = b"".join(gzip(data[k : k + 500]) for k in range(0, len(data), 500))
    assert b"".join(warc.plain(packed[k : k + 13] for k in range(0, len(packed), 13))) == data


def test_junk_leaves_in_bounded_rows_in_linear_time():
    import time

    good = warc.response(1, "u", "<p>x</p>")
    piece = bytes(range(1, 251)) * 4400

    def pieces(n):
        yield good
        for _ in range(n):
            yield piece
        yield good

    took = {}
    for n in (20, 80):
        start = time.perf_counter()
        out = list(warc.records(pieces(n)))
        took[n] = time.perf_counter() - start
        assert [e for *_, e in out if e is None] == [None, None] and sum(len(b.strip()) for _, b, e in out if e) >= n * len(piece) - 8 * len(out)
        assert max(len(b) for _, b, e in out if e) <= warc.PIECE
    assert took[80] < 20 * max(took[20], 0.01)


def test_long_headers_and_long_blocks(monkeypatch):
    long = warc.build([("WARC-Type", "response"), ("X", "y" * (3 << 20))], b"block")
    good = warc.response(1, "u", "<p>x</p>")
    out = list(warc.records([long[:100], long[100:] + good]))
    assert [e for *_, e in out] == [None, None] and out[0][1] == b"block"
    monkeypatch.setattr(warc, "RECORD", 1000)
    big = warc.build([("WARC-Type", "response")], b"z" * 5000)
    data = good + big + good
    for n in (7, 999, 10**6):
        out = list(warc.records(data[k : k + n] for k in range(0, len(data), n)))
        assert [e for *_, e in out] == [None, "block is too long", None]
    monkeypatch.setattr(warc, "HEAD", 500)
    assert [e for *_, e in warc.records([b"WARC/1.1\r\n" + b"h" * 2000])] == ["headers don't end"]


def test_padding_and_broken_members():
    a, b, c = (warc.response(k, "u", f"<p>{k}</p>") for k in range(3))
    broken = gzip(b)
    broken = broken[:30] + bytes(40) + broken[70:]
    cases = [
        (gzip(a) + bytes(5000) + gzip(b) + b"pad" + gzip(c), [None, None, None]),
        (gzip(a) + broken + gzip(c), [None, "error", None]),
        (gzip(a) + gzip(b)[:60], [None, "error"]),
    ]
    for data, want in cases:
        for n in (1, 13, 4096):
            out = list(warc.stream_records(data[k : k + n] for k in range(0, len(data), n)))
            errors = [e for *_, e in out]
            assert [e for e in errors if e is None] == [e for e in want if e is None] and any(errors) == ("error" in want)
            assert errors[0] is None and (errors[-1] is None) == (want[-1] is None)


def test_self_closed_links():
    assert warc.page_text("<p>x <a href='/u'/> y</p>")[2] == ["/u"]
