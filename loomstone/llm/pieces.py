"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a one-pass Viterbi.

The pieces and scores of a model file are read as a unigram model: an encoding is the sequence of pieces
with the largest sum of scores. The automaton reads a chunk once; at each position its output links give
every piece that ends there, and each relaxes the best score of that position. A character that no piece
covers becomes its byte pieces, at the score of an unknown one. No piece reaches from a word into the
blank after it, nor over a line end, so chunks between blanks are encoded apart and each distinct chunk
once; the joined chunks are the encoding of the whole text.

Edge cases: a null or empty text has no ids and decodes to the empty text; U+2581 in a text decodes to a
blank, as the format has it; of encodings with equal scores the one with the longer last piece wins, from
the end of a chunk on; repeated rows are encoded alike; a null doc_id stays null, and no id passes through
Python; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import batched, values

BLANK = "▁"
#: What an unknown character costs beyond the worst piece; a fixed value of the format.
UNKNOWN_PENALTY = 10.0
#: Chunks whose ids a worker keeps, at most.
CACHE = 100_000
_workers: dict[str, Pieces] = {}


class Pieces:
    """An encoder and decoder for one model file."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        ids = range(model.get_piece_size())
        self.text = [model.id_to_piece(i) for i in ids]
        self.bytes = {int(self.text[i][3:5], 16): i for i in ids if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        normal = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.silent = {i for i in ids if model.is_control(i) or model.is_unknown(i)}
        self.unknown = min(model.get_score(i) for i in normal) - UNKNOWN_PENALTY
        inner = [self.text[i] for i in normal if BLANK in self.text[i].lstrip(BLANK) or "\n" in self.text[i]]
        if inner:
            raise ValueError(f"pieces that reach over blanks or line ends: {inner[:3]}")
        self.automaton = ahocorasick.Automaton()
        for i in normal:
            self.automaton.add_word(self.text[i], (len(self.text[i]), model.get_score(i), i))
        self.automaton.make_automaton()
        viterbi = self.viterbi

        class Chunks(dict):
            def __missing__(self, chunk: str) -> tuple[int, ...]:
                out = viterbi(chunk)
                if len(self) >= CACHE:
                    self.clear()
                if len(chunk) < 64:
                    self[chunk] = out
                return out

        self.chunks = Chunks()

    def viterbi(self, chunk: str) -> tuple[int, ...]:
        n, lowest = len(chunk), float("-inf")
        best, last = [lowest] * (n + 1), [(0, -1)] * (n + 1)
        best[0], done = 0.0, 0

        def settle(upto: int) -> None:
            # Positions that no piece ends at are reached by an unknown character.
            nonlocal done
            while done < upto:
                done += 1
                unknown = best[done - 1] + self.unknown
                if unknown > best[done]:
                    best[done], last[done] = unknown, (1, -1)

        for end, (size, score, i) in self.automaton.iter(chunk):
            end += 1
            if end - 1 > done:
                settle(end - 1)
            score += best[end - size]
            if score > best[end]:
                best[end], last[end] = score, (size, i)
        settle(n)
        out: list[int] = []
        while n:
            size, i = last[n]
            out += [i] if i >= 0 else [self.bytes[b] for b in reversed(chunk[n - 1: n].encode())]
            n -= size
        return tuple(reversed(out))

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        get, line_end, out, blanks = self.chunks.__getitem__, (self.bytes[10],), [], ""
        for part in text.replace(" ", BLANK).split(BLANK):
            blanks += BLANK
            if not part:
                continue
            if "\n" not in part:
                out += get(blanks + part)
            else:
                first, *rest = part.split("\n")
                out += get(blanks + first)
                for line in rest:
                    out += line_end
                    if line:
                        out += get(line)
            blanks = ""
        if blanks:
            out += get(blanks)
        return out

    def decode(self, ids: list[int]) -> str:
        if self.byte_of.keys().isdisjoint(ids) and self.silent.isdisjoint(ids):
            text = "".join([self.text[i] for i in ids])
        else:
            parts = [bytes((self.byte_of[i],)) if i in self.byte_of else b"" if i in self.silent else self.text[i].encode() for i in ids]
            text = b"".join(parts).decode(errors="replace")
        return text.replace(BLANK, " ")[1:]


def pieces_of(model_path: str) -> Pieces:
    if model_path not in _workers:
        _workers[model_path] = Pieces(model_path)
    return _workers[model_path]


def encoded(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) -> doc_id, ids array<int>."""

    def ids(batch: pa.RecordBatch) -> tuple[None, list]:
        coder = pieces_of(model_path)
        return None, [[coder.encode(t or "") for t in values(batch, "text")]]

    return batched(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id"], "ids array<int>", ids)


def decoded(rows: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids) -> doc_id, text."""

    def texts(batch: pa.RecordBatch) -> tuple[None, list]:
        coder = pieces_of(model_path)
        return None, [[coder.decode(i or []) for i in values(batch, "ids")]]

    return batched(rows.select("doc_id", "ids"), ["doc_id"], "text string", texts)


def coded(docs: DataFrame, model_path: str) -> DataFrame:
    """Encode every text and decode its ids again: doc_id, n_ids, ids_sha256 (of little-endian 32-bit ids), n_chars, text_sha256 (decoded), round_trip."""

    def digests(batch: pa.RecordBatch) -> tuple[None, list]:
        coder, rows = pieces_of(model_path), []
        for text in values(batch, "text"):
            ids = coder.encode(text or "")
            back = coder.decode(ids)
            rows.append((len(ids), hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest(), len(back), hashlib.sha256(back.encode()).hexdigest(), back == (text or "").replace(BLANK, " ")))
        return None, list(zip(*rows, strict=True)) or [[]] * 5

    schema = "n_ids long, ids_sha256 string, n_chars long, text_sha256 string, round_trip boolean"
    return batched(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id"], schema, digests)
