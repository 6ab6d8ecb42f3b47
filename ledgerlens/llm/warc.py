"""WARC derivatives: metadata and plain-text conversion records built from response records.

``responses`` makes response records of pages, ``read_records`` splits WARC files (plain or gzip members)
into records as it streams through them, ``derive`` turns every response into two records that refer to it,
and ``write_records`` writes records as gzip members. Records are whole WARC/1.1 records in one binary column.
Both derivatives carry WARC-Refers-To, the target URI and the source's date; the metadata record keeps the
source's record headers, HTTP status and HTTP headers, its digests as given and as computed, and the outgoing
links. Files are opened through Arrow's file systems, by uri.

Cases: a null url or body counts as empty; a null record has no derivatives. A block that isn't an HTTP
response is converted as it is. Bytes that aren't in the declared charset, or whose charset isn't known, become
U+FFFD or are read as UTF-8. A binary may hold several records: each has its row. What isn't a record (no end
of the headers, no length, a block cut short or of over RECORD bytes, headers of over HEAD bytes, other bytes, broken
gzip) gives rows with column error and never fails the job; what follows it is read. Padding between gzip members is
passed over. An element whose text isn't shown and that is never closed hides nothing. Equal pages give
records with equal ids only where page_id and url are equal too. Records that aren't responses have no
derivatives. An empty table gives an empty result. Columns of other names are carried by ``derive``.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATE = "2024-01-01T00:00:00Z"
SKIPPED = frozenset(("script", "style", "template", "noscript"))
BLOCKS = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split())


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(31).join(map(str, parts)))}>"


def _line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def build(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record; the length is added."""
    head = "".join(f"{k}: {_line(v)}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


PIECE = 1 << 20  # bytes read at a time, and of an error row at most
HEAD = 1 << 26  # bytes of a record's headers at most; longer ones are no record
RECORD = 1 << 30  # bytes of a block at most: a row holds no more; a longer one is passed over
_MAGIC = b"WARC/1."


def records(pieces: Iterable[bytes]) -> Iterator[tuple[list[tuple[str, str]], bytes, str | None]]:
    """(headers, block, error) of all records in a stream of bytes.

    It holds one record and one piece, and looks at every byte a fixed number of times. Bytes that are no record leave
    in error rows of at most PIECE bytes as they come.
    """
    buffer, source = bytearray(), iter(pieces)

    def more() -> bool:
        if (piece := next(source, None)) is None:
            return False
        buffer.extend(piece)
        return True

    while True:
        # to the next record: what lies before it leaves in pieces, but for a tail that may start one
        while (at := buffer.find(_MAGIC)) < 0:
            whole = max(0, len(buffer) - len(_MAGIC)) // PIECE * PIECE
            for k in range(0, whole, PIECE):
                if (stray := bytes(buffer[k : k + PIECE])).strip():
                    yield [], stray, "bytes that are no record"
            del buffer[:whole]
            if not more():
                break
        between = bytes(buffer[:at] if at >= 0 else buffer)
        if between.strip():
            for k in range(0, len(between), PIECE):
                yield [], between[k : k + PIECE], "bytes that are no record"
        if at < 0:
            return
        del buffer[:at]
        seen = 0
        while (end := buffer.find(b"\r\n\r\n", seen)) < 0 and len(buffer) < HEAD:
            seen = max(0, len(buffer) - 3)
            if not more():
                break
        if end < 0:
            for k in range(0, len(buffer), PIECE):
                yield [], bytes(buffer[k : k + PIECE]), "headers don't end"
            buffer.clear()
            continue
        headers = _headers(bytes(buffer[:end]))
        length = get(headers, "Content-Length") or ""
        if not (length.isascii() and length.isdigit()):
            yield headers, b"", "no length"
            del buffer[: end + 4]
            continue
        del buffer[: end + 4]
        left = int(length)
        if left > RECORD:
            yield headers, b"", "block is too long"
            while left > len(buffer):
                left -= len(buffer)
                buffer.clear()
                if not more():
                    return
            del buffer[:left]
            continue
        while len(buffer) < left and more():
            pass
        block = bytes(buffer[:left])
        yield headers, block, None if len(block) == left else "block is cut short"
        del buffer[:left]


def parse(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(headers, block) of the whole records in data."""
    return ((h, b) for h, b, error in records([data]) if error is None)


def _headers(head: bytes) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], out[-1][1] + " " + line.strip())
        elif line:
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def get(headers: list[tuple[str, str]], name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name.lower()), None)


class Broken(bytes):
    """Stands for the rest of a gzip member that can't be read."""


_GZIP = b"\x1f\x8b\x08"


def plain(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """The bytes of all gzip members in a stream; the stream itself where it isn't gzip.

    What stands between members (padding, or the rest of a broken one, for which a ``Broken`` is given) is passed over up
    to the next one's first bytes.
    """
    member, packed, held = None, None, b""
    for piece in pieces:
        held += piece
        if packed is None and len(held) < len(_GZIP):
            continue
        packed = held.startswith(_GZIP) if packed is None else packed
        if not packed:
            yield held
            held = b""
        while held:
            if member is None:
                if (at := held.find(_GZIP)) < 0:
                    held = held[-2:]
                    break
                held, member = held[at:], zlib.decompressobj(31)
            try:
                data = member.decompress(held, PIECE)
                if data:
                    yield data
                while member.unconsumed_tail:
                    yield member.decompress(member.unconsumed_tail, PIECE)
                held = member.unused_data
                member = None if member.eof else member
            except zlib.error as e:
                yield Broken(str(e).encode())
                held, member = held[len(_GZIP) :], None
    if packed is None and held:
        yield held
    if member is not None:
        yield Broken(b"a gzip member is cut short")


def stream_records(pieces: Iterable[bytes]) -> Iterator[tuple[list[tuple[str, str]], bytes, str | None]]:
    """``records`` of the pieces that ``plain`` gives: a broken member ends the record that it stands in, with an error row of its own, and reading goes on behind it."""
    source, broken = plain(pieces), []

    def until_broken():
        for piece in source:
            if isinstance(piece, Broken):
                broken.append(piece)
                return
            yield piece

    while True:
        broken.clear()
        yield from records(until_broken())
        if not broken:
            return
        yield [], b"", broken[0].decode()


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.links: list[str] = []
        self.title: list[str] = []
        self.hidden: list[str] = []  # open elements whose text isn't shown
        self.held: list[str] = []  # their text, until they are closed
        self.in_title = False

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.hidden.append(tag)
        if tag in BLOCKS:
            self.parts.append("\n")
        if tag == "title":
            self.in_title = True
        if tag == "a":
            self.links += [v for k, v in attrs if k == "href" and v]

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCKS:
            self.parts.append("\n")
        if tag == "a":
            self.links += [v for k, v in attrs if k == "href" and v]

    def handle_endtag(self, tag):
        if tag in self.hidden:
            del self.hidden[self.hidden.index(tag) :]
            if not self.hidden:
                self.held = []
        if tag in BLOCKS:
            (self.held if self.hidden else self.parts).append("\n")
        if tag == "title":
            self.in_title = False

    def handle_data(self, data):
        if self.hidden:
            if self.hidden[-1] not in ("script", "style"):
                self.held.append(data)
            return
        self.parts.append(data)
        if self.in_title:
            self.title.append(data)

    def close(self):
        super().close()
        self.parts += self.held


def page_text(html: str) -> tuple[str, str, list[str]]:
    """(text, title, links): one line per block, white space collapsed."""
    p = _Page()
    p.feed(html)
    p.close()
    lines = (" ".join(x.split()) for x in "".join(p.parts).split("\n"))
    return "\n".join(x for x in lines if x), " ".join("".join(p.title).split()), p.links


def response(page_id: object, url: str, html: str, date: str = DATE) -> bytes:
    """A response record of one page."""
    body = html.encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body
    headers = [
        ("WARC-Type", "response"),
        ("WARC-Record-ID", record_id("response", page_id, url)),
        ("WARC-Date", date),
        ("WARC-Target-URI", url),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Block-Digest", digest(block)),
        ("WARC-Payload-Digest", digest(body)),
    ]
    return build(headers, block)


def derivatives(headers: list[tuple[str, str]], block: bytes) -> tuple[bytes, bytes] | None:
    """(metadata record, conversion record) of a response; None for records of another type."""
    if (get(headers, "WARC-Type") or "").lower() != "response":
        return None
    head, sep, body = block.partition(b"\r\n\r\n")
    is_http = bool(sep) and head.startswith(b"HTTP/")
    http = _headers(head) if is_http else []
    body = body if is_http else block
    status = (head.split(b"\r\n")[0].split(b" ", 2)[1:2] or [b""])[0].decode("ascii", "replace") if is_http else ""
    charset = re.search(r"charset=\"?([\w.:-]+)", get(http, "Content-Type") or "")
    text, title, links = page_text(_decode(body, charset[1] if charset else "utf-8"))
    source = get(headers, "WARC-Record-ID") or ""
    link = [
        ("WARC-Refers-To", source),
        ("WARC-Refers-To-Target-URI", get(headers, "WARC-Target-URI") or ""),
        ("WARC-Refers-To-Date", get(headers, "WARC-Date") or ""),
        ("WARC-Target-URI", get(headers, "WARC-Target-URI") or ""),
        ("WARC-Date", get(headers, "WARC-Date") or ""),
    ]
    if info := get(headers, "WARC-Warcinfo-ID"):
        link.append(("WARC-Warcinfo-ID", info))
    conversion_id, plain = record_id("conversion", source), text.encode()
    fields = [
        ("converted-to", conversion_id),
        *((f"source-{k.lower()}", v) for k, v in headers),
        ("computed-block-digest", digest(block)),
        ("computed-payload-digest", digest(body)),
        ("http-status", status),
        *((f"http-{k.lower()}", v) for k, v in http),
        ("title", title),
        *(("outlink", x) for x in links),
    ]
    about = "".join(f"{k}: {_line(v)}\r\n" for k, v in fields).encode("utf-8", "replace")
    metadata = build([("WARC-Type", "metadata"), ("WARC-Record-ID", record_id("metadata", source)), *link, ("Content-Type", "application/warc-fields"), ("WARC-Block-Digest", digest(about))], about)
    conversion = build([("WARC-Type", "conversion"), ("WARC-Record-ID", conversion_id), *link, ("Content-Type", "text/plain; charset=utf-8"), ("WARC-Block-Digest", digest(plain))], plain)
    return metadata, conversion


def _decode(body: bytes, charset: str) -> str:
    try:
        return body.decode(charset, "replace")
    except (LookupError, UnicodeError, ValueError):
        return body.decode("utf-8", "replace")


# over tables


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """page_id and record: a response record of every row (page_id, url, html)."""

    def run(batches):
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array([response("" if i is None else i, u or "", h or "", date) for i, u, h in rows], pa.binary())], ["page_id", "record"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, record binary")


def derive(rows: DataFrame) -> DataFrame:
    """rows with columns position, metadata, conversion and error added: one row for every record in column record."""

    def made(data: bytes | None) -> list[dict]:
        out = []
        for k, (headers, block, error) in enumerate(records([data or b""])):
            metadata, conversion = (None if error else derivatives(headers, block)) or (None, None)
            out.append({"position": k, "metadata": metadata, "conversion": conversion, "error": error})
        return out or [{"position": 0, "metadata": None, "conversion": None, "error": None}]

    kind = pa.list_(pa.struct([("position", pa.int64()), ("metadata", pa.binary()), ("conversion", pa.binary()), ("error", pa.string())]))

    def run(record: pa.Array) -> pa.Array:
        return pa.array([made(x) for x in record.to_pylist()], kind)

    made_of = F.arrow_udf(run, "array<struct<position: long, metadata: binary, conversion: binary, error: string>>")
    own = ("position", "metadata", "conversion", "error")
    each = rows.select(*[c for c in rows.columns if c not in own], F.explode(made_of("record")).alias("__made"))
    return each.select(*[c for c in rows.columns if c not in own], *[f"__made.{c}" for c in own])


def _files(uri: str):
    """(Arrow file system, path) of a uri or a plain path."""
    from pyarrow.fs import FileSystem

    scheme, sep, rest = uri.partition(":")
    return FileSystem.from_uri("file:///" + rest.lstrip("/") if sep and scheme == "file" else uri)


def _pieces(uri: str) -> Iterator[bytes]:
    files, path = _files(uri)
    with files.open_input_stream(path, compression=None) as f:
        while piece := f.read(PIECE):
            yield piece


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """path, position, record and error of all records in the WARC files under path; a task holds one record of a file at a time."""

    def run(batches):
        for b in batches:
            for name in b.column("path").to_pylist():
                for k, (headers, block, error) in enumerate(stream_records(_pieces(name))):
                    record = block if error else build([x for x in headers if x[0].lower() != "content-length"], block)
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int64()), pa.array([record], pa.binary()), pa.array([error], pa.string())], ["path", "position", "record", "error"])

    names = spark.read.format("binaryFile").load(path).select("path")  # the files' contents aren't read here
    return names.mapInArrow(run, "path string, position long, record binary, error string")


def write_records(rows: DataFrame, folder: str) -> DataFrame:
    """Write column record as one .warc.gz file per task into folder; returns file and n_records.

    A file is written beside its name and moved, so a repeated task leaves one whole file.
    """

    def run(batches):
        files, where = _files(folder)
        files.create_dir(where, recursive=True)
        name, n = f"part-{TaskContext.get().partitionId():06d}.warc.gz", 0
        beside = f"{where}/.{name}-{uuid.uuid4().hex}"
        with files.open_output_stream(beside, compression=None) as f:
            for b in batches:
                for x in b.column("record").to_pylist():
                    if x is not None:
                        z = zlib.compressobj(wbits=31)
                        f.write(z.compress(x) + z.flush())
                        n += 1
        files.move(beside, f"{where}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["file", "n_records"])

    return rows.select("record").mapInArrow(run, "file string, n_records long")


def summary(pages: DataFrame) -> DataFrame:
    """Per page, read from its derivative records: ids, links between them, digests and sizes."""
    made = derive(responses(pages)).select("page_id", "metadata", "conversion")
    names = ["page_id", "response_id", "metadata_id", "conversion_id", "target_uri", "source_date", "http_status", "payload_digest", "digest_agrees", "n_links", "title", "text_digest", "text_sha256", "n_chars"]

    def run(batches):
        for b in batches:
            rows = []
            for i, m, c in zip(*(b.column(k).to_pylist() for k in ("page_id", "metadata", "conversion")), strict=True):
                (mh, about), (ch, text) = next(parse(m)), next(parse(c))
                fields = _headers(b"\r\n" + about)
                if get(mh, "WARC-Refers-To") != get(ch, "WARC-Refers-To") or get(fields, "converted-to") != get(ch, "WARC-Record-ID"):
                    raise ValueError("derivatives aren't linked")
                rows.append((i, get(ch, "WARC-Refers-To"), get(mh, "WARC-Record-ID"), get(ch, "WARC-Record-ID"), get(ch, "WARC-Refers-To-Target-URI"), get(ch, "WARC-Refers-To-Date"), get(fields, "http-status"), get(fields, "source-warc-payload-digest"), get(fields, "source-warc-payload-digest") == get(fields, "computed-payload-digest"), sum(k == "outlink" for k, _ in fields), get(fields, "title"), get(ch, "WARC-Block-Digest"), hashlib.sha256(text).hexdigest(), len(text.decode())))
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            types = [b.column("page_id").type, *[pa.string()] * 7, pa.bool_(), pa.int64(), *[pa.string()] * 3, pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names)

    page_type = pages.schema["page_id"].dataType.simpleString()
    kinds = [page_type, *["string"] * 7, "boolean", "long", *["string"] * 3, "long"]
    return made.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
