"""ZIP archives of tables, and tables by their names in a folder or an archive."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.arrow import with_arrow


def unzip(data: bytes) -> list[tuple[str, bytes]]:
    """(name, content) of a ZIP archive's files. Encryption and methods other than stored and deflated are errors."""
    out = []
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                if info.is_dir():
                    continue
                if info.flag_bits & 1:
                    raise ValueError(f"{info.filename} is encrypted")
                if info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                    raise ValueError(f"{info.filename} has method {info.compress_type}")
                out.append((info.filename, z.read(info)))
    except zipfile.BadZipFile as e:
        raise ValueError(str(e)) from e
    return out


def read_zip(archives: DataFrame, column: str = "content") -> DataFrame:
    """(table, name, body) of each file in the archives of ``column``, and ``error``; other columns stay.

    ``table`` is the file's base name in lower case where it ends in .txt or .csv, else null. An archive that cannot be
    read gives one row with its error; a null one none.
    """

    def entries(values: list[bytes | None]) -> list[tuple]:
        out = []
        for v in values:
            try:
                out.append((unzip(v) if v is not None else [], None))
            except ValueError as e:
                out.append(([(None, None)], str(e)))
        return out

    d = with_arrow(archives, F.col(f"`{column}`").cast("binary"), [("_files", "array<struct<name:string,body:binary>>"), ("error", "string")], entries)
    kept = [F.col(f"`{c}`") for c in d.columns if c not in ("_files", column)]
    rows = d.select(*kept, F.explode("_files").alias("_f")).select(*kept, "_f.name", "_f.body")
    base = F.lower(F.element_at(F.split("name", "/"), -1))
    return rows.withColumn("table", F.when(base.rlike(r"\.(?:txt|csv)$"), F.regexp_replace(base, r"\.(?:txt|csv)$", "")))
