"""WARC archives: one gzip member per record, read back by splits.

Writing goes through Spark's text writer, so any file system and the commit of
tasks are Spark's own. A value is the bytes of one member without its last byte, and
the writer's line end is that byte: zero, the top byte of the size that ends a member.
(A member of 16 MiB or more is followed by an empty member, which ends in zero.)

Reading: the text reader splits files into byte ranges and cuts them at the gzip
magic, so a row is a candidate member and belongs to the range it starts in. A task
validates candidates by decoding their headers: one that does not start a WARC record
is a piece of the member before it, and one too short to tell is decoded with the pieces
after it (the magic may be in the head of a member). A member that runs on into the next range leaves
its pieces as loose rows; they are few and are joined per file.

Hadoop's reader inflates files whose name ends in .gz as one stream, so archives need
another ending (such as .warc); a name in .gz raises an error.

Defined results: null payloads are empty; an archive folder without files gives no
rows; a member that never ends raises an error rather than getting lost.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.runtime import cut_lineage

MAGIC = b"\x1f\x8b\x08"
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00" + bytes(8)
LEAST_REVISIT = 100
RECORD = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
PIECE = "file string, at long, part long, piece binary, record boolean"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = packer.compress(data) + packer.flush()
    return out if out.endswith(b"\x00") else out + EMPTY_MEMBER


def build_record(record_id: str, kind: str, uri: str, refers_to: str | None, digest: str, size: int, payload: bytes) -> bytes:
    """A response with its payload, or a revisit with the HTTP head of the payload alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    uri = "".join(c for c in uri if c >= " ")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, size = fields.get("warc-type", ""), len(payload)
    digest = hashlib.sha256(payload).hexdigest()
    if kind == "revisit":  # the payload is in another record; this one has its head and digest
        digest = fields["warc-payload-digest"].removeprefix("sha256:")
        size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
    return {
        "record_id": fields.get("warc-record-id", "").strip("<>"),
        "record_type": kind,
        "target_uri": fields.get("warc-target-uri"),
        "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
        "payload_digest": digest,
        "payload_bytes": size,
        "payload": payload,
    }


def mark_revisits(records: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Adds record_type and refers_to to rows of (page_id, uri, payload, digest, size).

    Equal payloads of at least ``least`` bytes: that with the smallest id is the
    response. The hot digest is combined before the shuffle; the join back is split by
    adaptive execution. Small payloads have keys of their own and meet nobody.
    """
    key = F.when(F.col("size") >= least, F.col("digest")).otherwise(F.concat(F.lit("small-"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    big = records.where(F.col("size") >= least)
    first = cut_lineage(big.groupBy(F.col("digest").alias("key")).agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("same")).where("same > 1"))
    rows = records.withColumn("key", key).join(first, "key", "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.select(
        *records.columns,
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(again, F.col("first_id")).alias("refers_to"),
    )


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", body_col: str = "html") -> None:
    """Write one record per row under ``path``."""
    body = F.coalesce(F.col(body_col).cast("binary"), F.lit(b""))
    records = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(uri_col).cast("string"), F.lit("")).alias("uri"), body.alias("payload"))
    records = records.select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("size"))

    def pack(batches):
        for batch in batches:
            names = batch.schema.names
            out = []
            for row in range(batch.num_rows):
                r = {n: batch.column(i)[row].as_py() for i, n in enumerate(names)}
                refers = None if r["refers_to"] is None else f"urn:page:{r['refers_to']}"
                data = build_record(f"urn:page:{'' if r['page_id'] is None else r['page_id']}", r["record_type"], r["uri"], refers, r["digest"], r["size"], r["payload"])
                out.append(member(data)[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    marked = mark_revisits(records)
    packed = marked.mapInArrow(pack, "member binary")
    packed.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\x00").option("compression", "none").text(path)


def _whole(buffer: bytes) -> bytes | None:
    """The decoded member, or None if more bytes are needed."""
    unpack = zlib.decompressobj(31)
    data = unpack.decompress(buffer)
    return data + unpack.flush() if unpack.eof else None


def _starts_record(piece: bytes) -> bool | None:
    """Decode enough of a candidate to see the head of a WARC record; None if it ends before that."""
    for part in (piece[:4096], piece):
        unpack = zlib.decompressobj(31)
        try:
            head = unpack.decompress(part, 5)
        except zlib.error:
            return False
        if len(head) == 5 or unpack.eof or not b"WARC/".startswith(head):
            return head == b"WARC/"
    return None


def _empty(piece: bytes) -> bool:
    """Whether a candidate is a member without content."""
    try:
        return len(piece) < 64 and _whole(piece) == b""
    except zlib.error:
        return False


def _members(pieces):
    """From (in order) pieces of one range: (True, bytes) for whole records, (False, piece) for loose ones.

    Loose are the pieces before the first record, and those of a last member that goes on.
    """
    held: list[bytes] | None = None
    open_: list[bytes] = []  # pieces that together are too short to tell
    for piece in pieces:
        starts = _starts_record(piece)
        if held is not None:
            if starts:
                raise ValueError("a WARC member has no end")
            held.append(piece)
        else:
            while open_:
                both = _starts_record(b"".join([*open_, piece]))
                if both:
                    held, open_ = [*open_, piece], []
                elif both is None and not starts:
                    break
                else:  # the first of them starts no record; the next one may
                    yield False, open_.pop(0)
            if held is not None:
                pass
            elif open_ or starts is None:
                open_.append(piece)
                continue
            elif starts:
                held = [piece]
            elif _empty(piece):
                continue
            else:
                yield False, piece
                continue
        data = _whole(b"".join(held))
        if data is not None:
            yield True, data
            held = None
    for piece in held or open_:
        yield False, piece


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives under ``path``: see RECORD."""
    raw = spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    raw = raw.select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))

    def scan(batches):
        def rows():
            for batch in batches:
                yield from zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist())

        def candidates(file, at, pieces):
            if file.endswith(".gz"):
                raise ValueError(f"{file}: the reader inflates names in .gz as a whole; give archives another ending")
            for number, (piece, _, _) in enumerate(pieces):
                if number == 0 and at == 0:  # what is before the first magic of a file
                    if len(piece.as_py()):
                        raise ValueError(f"{file} does not start with a gzip member")
                else:
                    yield MAGIC + piece.as_py()

        out, size = [], 0
        for (file, at), pieces in itertools.groupby(rows(), key=lambda row: row[1:]):
            for part, (whole, data) in enumerate(_members(candidates(file, at, pieces))):
                out.append((file, at, part, data, whole))
                size += len(data)
                if size > 8 << 20:
                    yield _piece_batch(out)
                    out, size = [], 0
        if out:
            yield _piece_batch(out)

    found = cut_lineage(raw.mapInArrow(scan, PIECE))

    def join_file(table: pa.Table) -> pa.Table:
        order = table.sort_by([("at", "ascending"), ("part", "ascending")])
        done = []
        for whole, data in _members(order["piece"].to_pylist()):
            if not whole:
                raise ValueError("a WARC member has no end or no start")
            done.append(("", 0, 0, data, True))
        return pa.Table.from_batches([_piece_batch(done)])

    loose = found.where("not record").groupBy("file").applyInArrow(join_file, PIECE)

    def decode(batches):
        names = [x.split()[0] for x in RECORD.split(", ")]
        for batch in batches:
            got = [parse_record(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[n] for g in got], pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string()) for n in names], names
            )

    return found.where("record").unionByName(loose).select("piece").mapInArrow(decode, RECORD)


def _piece_batch(rows: list) -> pa.RecordBatch:
    file, at, part, piece, record = zip(*rows) if rows else ((),) * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(file, pa.string()), pa.array(at, pa.int64()), pa.array(part, pa.int64()), pa.array(piece, pa.binary()), pa.array(record, pa.bool_())],
        ["file", "at", "part", "piece", "record"],
    )
