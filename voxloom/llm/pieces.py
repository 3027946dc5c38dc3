"""SentencePiece encoding by an Aho-Corasick automaton and Viterbi, and decoding.

The automaton runs once over the text; at each position its output links give all pieces that end there, and each of
them relaxes the best score of the position.  The best path has the largest sum of the model's piece scores; of equal
ones, the one with the longer last piece, from the end backwards.  A character that no piece begins or covers costs
``UNKNOWN_COST`` below the least score and becomes byte pieces.

Pieces hold the space mark at their beginning only, but for runs of marks, so a text is coded stretch by stretch: each
begins with its marks.  Workers remember the stretches they have coded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, free, table, texts

MARK = "▁"
UNKNOWN_COST = 10.0
CACHE = 500_000


class Codec:
    """A model file's pieces. An identity normaliser with a leading space mark is taken for granted, as the file says."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.scores = np.array([model.get_score(i) for i in range(n)])
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)]
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.byte_at = np.full(n, -1)
        for b, i in self.byte.items():
            self.byte_at[i] = b
        self.unknown = model.unk_id()
        self.shown = ["" if model.is_control(i) else " ⁇ " if i == self.unknown else p.replace(MARK, " ") for i, p in enumerate(self.pieces)]
        self.automaton = ahocorasick.Automaton()
        plain = [i for i in range(n) if not special[i]]
        for i in plain:
            self.automaton.add_word(self.pieces[i], (i, len(self.pieces[i]), float(self.scores[i])))
        self.automaton.make_automaton()
        self.cost = float(self.scores[plain].min()) - UNKNOWN_COST
        #: whether no piece has a mark behind another character
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", self.pieces[i]) for i in plain)
        self.stretches = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.known: dict[str, bytes] = {}

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best path of an escaped text."""
        n, cost = len(text), self.cost
        best, back = [0.0] + [-np.inf] * n, [None] * (n + 1)
        at = 0  # positions up to here are final
        matches = self.automaton.iter(text)
        found = next(matches, None)
        while at < n:
            at += 1
            # the unknown character first: any piece is better; output links then give longer pieces before shorter ones
            top, way = best[at - 1] + cost, (-1, 1)
            while found is not None and found[0] == at - 1:
                i, size, score = found[1]
                s = best[at - size] + score
                if s > top or s == top and size > way[1]:
                    top, way = s, (i, size)
                found = next(matches, None)
            best[at], back[at] = top, way
        out = []
        while at:
            i, size = back[at]
            if i >= 0:
                out.append(i)
            elif self.byte:
                out += [self.byte[b] for b in reversed(text[at - 1].encode())]
            else:
                out.append(self.unknown)
            at -= size
        return out[::-1]

    def _stretch(self, text: str) -> bytes:
        return np.array(self.viterbi(text), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; none for the empty text."""
        if not text:
            return b""
        whole = MARK + text.replace(" ", MARK)
        parts = self.stretches(whole) if self.splits else [whole]
        try:
            return b"".join(map(self.known.__getitem__, parts))
        except KeyError:
            if len(self.known) >= CACHE:
                self.known.clear()
            for x in set(parts).difference(self.known):
                self.known[x] = self._stretch(x)
            return b"".join(map(self.known.__getitem__, parts))

    def decode(self, ids: bytes) -> str:
        """The text of ids; runs of byte pieces that aren't UTF-8 give U+FFFD for each byte that fails."""
        at = np.frombuffer(ids, "<u4")
        if not (self.byte_at[at] >= 0).any():
            text = "".join(map(self.shown.__getitem__, at.tolist()))
        else:
            out, raw = [], bytearray()
            for i in at.tolist():
                if (b := self.byte_at[i]) >= 0:
                    raw.append(b)
                    continue
                if raw:
                    out.append(raw.decode(errors="replace"))
                    raw = bytearray()
                out.append(self.shown[i])
            text = "".join(out) + raw.decode(errors="replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The worker's codec of a file."""
    return Codec(path)


def default_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _per_text(df: DataFrame, column: str, name: str, kind: str, arrow: pa.DataType, function) -> DataFrame:
    bounded_batches(df.sparkSession)
    keep = [c for c in df.columns if c != name]
    schema = df.select(*keep).schema.add(name, kind)  # of a new frame: a frame's schema is one object, and add changes it
    given = free(df.columns, "in")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([function(x) for x in b.column(b.num_columns - 1).to_pylist()], arrow)], names=[*keep, name])

    return df.select(*keep, F.col(column).alias(given)).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str | None = None, text_col: str = "text", out: str = "piece_ids") -> DataFrame:
    """docs with the ids of each text (binary).  Null and empty texts have none; a column of that name is replaced.

    Texts are taken whole, however long, in time proportional to their length; repeated rows are encoded each; no rows: no
    rows.
    """
    path = path or default_path()
    return _per_text(docs, text_col, out, "binary", pa.binary(), lambda t: codec(path).encode(t or ""))


def decode(rows: DataFrame, path: str | None = None, ids_col: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """rows with the text of each row's ids.  Null ids: the empty text."""
    path = path or default_path()
    return _per_text(rows, ids_col, out, "string", pa.string(), lambda x: codec(path).decode(x or b""))


def op3(spark, sf_dir: str) -> DataFrame:
    """Ids encoded and decoded again: their number and crc32, and the decoded text's characters and crc32."""
    path = default_path()
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).select("doc_id", "piece_ids", F.coalesce("text", F.lit("")).alias("text"))
    back = decode(coded, path)
    return back.select("doc_id", (F.length("piece_ids") / 4).cast("long").alias("n_pieces"), F.crc32("piece_ids").alias("ids_crc32"), F.length("decoded").cast("long").alias("n_chars"), F.crc32(F.col("decoded").cast("binary")).alias("text_crc32"), (F.col("decoded") == F.col("text")).alias("same"))
