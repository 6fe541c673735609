"""ZIP archives to the bytes of their members."""

from __future__ import annotations

import io
import posixpath
import stat
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tracemill.functions.records import MEMBER_EXTENSIONS
from tracemill.schema import IngestParams

KEYS = ("case_id", "evidence_id", "declared_type")
_FOUND = pa.schema([*((k, pa.string()) for k in KEYS), ("entry", pa.int32()), *((c, pa.string()) for c in ("member_path", "member_status", "detail", "reject", "error")),
                    ("content", pa.binary())])
FOUND = ", ".join(f"{f.name} {'int' if f.name == 'entry' else 'binary' if f.name == 'content' else 'string'}" for f in _FOUND)


def member_label(path: str) -> str:
    """A member's path without drive tricks: no empty, ``.`` or ``..`` parts."""
    kept = [part for part in posixpath.normpath(path.replace("\\", "/")).split("/") if part not in ("", ".", "..")]
    return "/".join(kept) if kept else "unnamed"


def _verdict(info: zipfile.ZipInfo, label: str, p: IngestParams) -> dict | None:
    """Why a member stays closed; some members are then kept as a rejected record."""
    ratio = info.file_size / max(info.compress_size, 1) if info.compress_size else 0.0
    dropped = {"symlink entry": stat.S_ISLNK(info.external_attr >> 16), "encrypted entry": bool(info.flag_bits & 1),
               "nested archive not expanded": label.lower().endswith(".zip")}
    rejected = {f"unsupported member type (allowed: {', '.join(sorted(MEMBER_EXTENSIONS))})": not label.lower().endswith(MEMBER_EXTENSIONS),
                f"member exceeds per-member size limit ({info.file_size} > {p.zip_max_member})": info.file_size > p.zip_max_member,
                f"member compression ratio {ratio:.0f}:1 exceeds the limit {p.zip_max_ratio:.0f}:1": ratio > p.zip_max_ratio}
    for reasons, keep in ((dropped, False), (rejected, True)):
        reason = next((text for text, hit in reasons.items() if hit), None)
        if reason:
            return {"member_status": "skipped", "detail": reason, "reject": reason if keep else None}
    return None


def open_members(data: bytes, p: IngestParams) -> Iterator[dict]:
    """The members of an archive in name order, numbered from 1; one row with ``error`` where it cannot be opened."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as error:
        yield {"entry": 0, "error": f"not a readable ZIP archive: {error}"}
        return
    infos = archive.infolist()
    if len(infos) > p.zip_max_members:
        yield {"entry": 0, "error": "archive contains more members than the configured limit"}
        return
    if sum(i.file_size for i in infos) > p.zip_max_total:
        yield {"entry": 0, "error": "archive expands beyond the configured total size limit"}
        return
    files = sorted((i for i in infos if not i.is_dir()), key=lambda i: i.filename)
    if not files:
        yield {"entry": 0}
    for number, info in enumerate(files, start=1):
        label = member_label(info.filename)
        found = {"entry": number, "member_path": label, **(_verdict(info, label, p) or {"member_status": "ok"})}
        if found["member_status"] == "ok":
            try:
                found["content"] = archive.read(info)
            except (RuntimeError, zipfile.BadZipFile, OSError) as error:
                found |= {"member_status": "failed", "detail": f"unreadable member: {type(error).__name__}"}
        yield found


def unpack(archives: DataFrame, p: IngestParams = IngestParams()) -> DataFrame:
    """One row a member with its bytes, dealt out anew, so members of one archive are read by different tasks.

    ``archives`` has the keys and ``content``. Python only inflates here; one
    member's bytes are held at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                keys = {k: batch.column(i)[row].as_py() for i, k in enumerate(KEYS)}
                for found in open_members(batch.column(len(KEYS))[row].as_py(), p):
                    yield pa.RecordBatch.from_pylist([keys | found], schema=_FOUND)

    return archives.select(*KEYS, "content").mapInArrow(run, FOUND).repartition("case_id", "evidence_id", "entry")
