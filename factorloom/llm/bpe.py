"""BPE encoding and decoding by forced boundaries (operator 5)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, text_view
from .fragments import TextEncoder, encoder


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, with_text: bool = True) -> DataFrame:
    """Ids and decoded text of every row of ``docs``, one row for each, in one pass without a shuffle.

    Returns ``id_col, n_tokens long, ids_sha256, decoded_sha256`` and, if asked, ``ids array<int>`` and ``decoded``.
    The shas are lowercase hex: of the decimal ids joined by one space, and of the decoded text in UTF-8.

    Cases: null text counts as empty; an empty text has no ids, "" as decoded text and the sha of nothing; a null id
    stays null; repeated rows come out repeated; an empty table gives no rows; further columns of ``docs`` are
    dropped, whatever their names; texts of any length are encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, TextEncoder)
        for batch in pieces(batches, "text", 4 << 20):
            ids, first = enc.encode(*text_view(batch.column("text")))
            n_tokens, id_text, token_text = np.diff(first), enc.id_text, enc.token_text
            out: dict[str, list] = {"ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
            for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                own = ids[a:b].tolist()
                text = " ".join([token_text[i] for i in own])
                out["ids_sha256"].append(hashlib.sha256(" ".join([id_text[i] for i in own]).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
                if with_ids:
                    out["ids"].append(ids[a:b])
                if with_text:
                    out["decoded"].append(text)
            columns = [batch.column("id"), pa.array(n_tokens, pa.int64()), pa.array(out["ids_sha256"]), pa.array(out["decoded_sha256"])]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(out["ids"], pa.list_(pa.int32())))
                names.append("ids")
            if with_text:
                columns.append(pa.array(out["decoded"], pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"{id_col} {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" * with_ids + ", decoded string" * with_text
    return rows.mapInArrow(run, schema)
