"""HTML extraction by nearest-URL page differencing.

Pages are cut into lines of text. Within each host pages are ordered by URL path, each is paired
with the neighbour whose path shares the longer prefix, their lines are aligned by longest common
subsequence, and shared lines are deleted: what two neighbouring pages have in common is their
template. Markup only speaks for single lines: those of <article> or <main> are content and are not
deleted (two pages may quote one passage), those of menus, footers, forms, adverts and the like are
dropped. Every other line, on a page with or without <article>, is decided by differencing alone: it
stays unless the neighbour has it too. A neighbour that has every line of a page is a copy of it and
shows no template, so the other one is taken; if both are copies, nothing is deleted.

The order over (host, path) is a range partitioning, so a host with a third of all pages is spread
over many tasks; neighbours across a partition edge are found in a table of two rows a partition.
Only line hashes travel for pairing. A page's own lines are shuffled once, compressed.

Defined cases: a null or empty page gives an empty text; a null URL is a host of its own without
path; repeated rows (equal URL and page) are paired once and each gets the result; further columns
are left aside; an empty table gives an empty result. A very long page is parsed in one task, in time
proportional to its length, and aligned in lines x lines / 64 steps.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from effortlens.llm import markup
from effortlens.llm.storage import stored

_URL = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^?#]*)")
_SORTED = "host string, path string, key binary, sig binary, part int, seq long, edge boolean, prev_host string, prev_path string, prev_sig binary, next_host string, next_path string, next_sig binary"


def host_and_path(url: str | None) -> tuple[str, str]:
    m = _URL.match(url or "")
    return (m[1].lower(), m[2]) if m else ("", url or "")


def _key(url: str | None, page: str | None) -> bytes:
    digest = hashlib.blake2b(digest_size=16)
    for part in (url, page):
        raw = b"" if part is None else part.encode("utf-8", "surrogatepass")
        digest.update(len(raw).to_bytes(8, "little") + raw)
    return digest.digest()


def _line_hash(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """url, html -> host, path, key, sig (8 bytes a line)."""
    for batch in batches:
        out = []
        for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sig = b"".join(_line_hash(text) for text, _ in markup.lines(page or ""))
            out.append((*host_and_path(url), _key(url, page), sig))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.binary(), pa.binary()), strict=True)]
            if out
            else [pa.array([], t) for t in (pa.string(), pa.string(), pa.binary(), pa.binary())],
            ["host", "path", "key", "sig"],
        )


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page_id, url, html -> page_id, url, key, z: the lines that markup does not drop, compressed."""
    for batch in batches:
        keys, packed = [], []
        for url, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            keys.append(_key(url, page))
            found = [(k, text, kind) for k, (text, kind) in enumerate(markup.lines(page or "")) if kind != markup.DROP]
            packed.append(zlib.compress(json.dumps(found, ensure_ascii=False).encode("utf-8", "surrogatepass"), 1))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(packed, pa.binary())], ["page_id", "url", "key", "z"]
        )


def _with_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order -> the same with the row before and after in this partition; edge marks first and last."""
    part, seq = TaskContext.get().partitionId(), 0
    before, here, out = None, None, []
    schema = pa.schema(
        [("host", pa.string()), ("path", pa.string()), ("key", pa.binary()), ("sig", pa.binary()), ("part", pa.int32()), ("seq", pa.int64()), ("edge", pa.bool_())]
        + [(f"{side}_{name}", pa.string() if name != "sig" else pa.binary()) for side in ("prev", "next") for name in ("host", "path", "sig")]
    )

    def row(after):
        near = lambda x: (None, None, None) if x is None else (x[0], x[1], x[3])
        return (*here, part, seq, before is None or after is None, *near(before), *near(after))

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        for item in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if here is not None:
                out.append(row(item))
                seq += 1
                before = here
            here = item
            if len(out) >= 1000:
                yield batch_of(out)
                out = []
    if here is not None:
        out.append(row(None))
    if out:
        yield batch_of(out)


def common_lines(a: list[bytes], b: list[bytes]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence of a and b.

    What both begin and end with is set aside. For the rest, row i holds as the zero bits of one long
    integer where the subsequence of a[:i] grows along b, so a row costs a few operations on
    len(b) bits, whether lines repeat or not.
    """
    front = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    most = min(len(a), len(b)) - front
    back = next((k for k in range(most) if a[-1 - k] != b[-1 - k]), most)
    mid_a, mid_b = a[front : len(a) - back], b[front : len(b) - back]
    places: dict[bytes, int] = {}
    for j, x in enumerate(mid_b):
        places[x] = places.get(x, 0) | (1 << j)
    every = (1 << len(mid_b)) - 1
    rows = [every]
    for x in mid_a:
        row = rows[-1]
        met = row & places.get(x, 0)
        rows.append(((row + met) | (row - met)) & every)
    found, j = [], len(mid_b)
    for i in range(len(mid_a), 0, -1):
        while j and mid_a[i - 1] != mid_b[j - 1] and rows[i] >> (j - 1) & 1:  # b[j - 1] adds nothing here
            j -= 1
        if not j:
            break
        if mid_a[i - 1] == mid_b[j - 1]:
            found.append(front + i - 1)
            j -= 1
    return [*range(front), *reversed(found), *range(len(a) - back, len(a))]


def _shared_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


def _cut(sig: bytes) -> list[bytes]:
    return [sig[k : k + 8] for k in range(0, len(sig), 8)]


def _deletions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, path, key, sig and both neighbours -> key, gone: the lines shared with the nearer one that is no copy."""
    for batch in batches:
        keys, gone = [], []
        for host, path, key, sig, ph, pp, ps, nh, np_, ns in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            near = [(_shared_prefix(path, p), s) for h, p, s in ((nh, np_, ns), (ph, pp, ps)) if h == host and s is not None]
            keys.append(key)
            if not near:
                gone.append([])
                continue
            own = _cut(sig)
            found = (common_lines(own, _cut(s)) for _, s in sorted(near, key=lambda x: -x[0]))
            gone.append(next((shared for shared in found if len(shared) < len(own)), []))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(gone, pa.list_(pa.int32()))], ["key", "gone"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page_id, url, z, gone -> page_id, url, text."""
    for batch in batches:
        texts = []
        for z, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            found = json.loads(zlib.decompress(z).decode("utf-8", "surrogatepass"))
            shared = set(gone or ())
            texts.append("\n\n".join(text for k, text, kind in found if kind == markup.KEEP or k not in shared))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def neighbours(signatures: DataFrame) -> DataFrame:
    """host, path, key, sig in the order of (host, path, key), each with the rows before and after it."""
    ordered = signatures.repartitionByRange("host", "path", "key").sortWithinPartitions("host", "path", "key")
    rows = stored(ordered.mapInArrow(_with_neighbours, _SORTED), "neighbours")
    # two rows a partition at most
    w = Window.orderBy("part", "seq")
    edges = rows.where("edge").select(
        F.col("part").alias("e_part"),
        F.col("seq").alias("e_seq"),
        *[F.lag(c).over(w).alias(f"lag_{c}") for c in ("host", "path", "sig")],
        *[F.lead(c).over(w).alias(f"lead_{c}") for c in ("host", "path", "sig")],
    )
    joined = rows.join(edges, (F.col("part") == F.col("e_part")) & (F.col("seq") == F.col("e_seq")), "left")
    return joined.select(
        "host",
        "path",
        "key",
        "sig",
        *[F.coalesce(f"prev_{c}", f"lag_{c}").alias(f"prev_{c}") for c in ("host", "path", "sig")],
        *[F.coalesce(f"next_{c}", f"lead_{c}").alias(f"next_{c}") for c in ("host", "path", "sig")],
    )


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page row: id, url, text."""
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    signatures = rows.select("url", "html").mapInArrow(_signatures, "host string, path string, key binary, sig binary").dropDuplicates(["key"])
    gone = neighbours(signatures).mapInArrow(_deletions, "key binary, gone array<int>")
    contents = rows.mapInArrow(_contents, f"page_id {kind}, url string, key binary, z binary")
    texts = contents.join(gone, "key", "left").select("page_id", "url", "z", "gone").mapInArrow(_texts, f"page_id {kind}, url string, text string")
    return texts.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text")
