"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

Texts are cut at the places where white space follows other characters; no
token crosses these, so each distinct chunk is encoded once and kept in the
worker's memo.  Unseen chunks are split into words by the tokenizer's pattern.
The symbols of all these words stand in one flat array.  A round looks up every
adjacent pair by binary search over the sorted pair keys, takes each word's
lowest rank, and merges all places of that pair, leftmost first; words without
a known pair leave the array.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.llm import textbuf
from plantpulse.llm.word_encoder import Memo

U64 = np.uint64
#: Unicode white space, as the tokenizer's pattern means it (fixed values).
_WS = r"\t-\r \x85\xa0  -     　"
#: The published word pattern of this tokenizer family (fixed value).
PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: Letters and numbers that newer Unicode tables than the tokenizer's add
#: (fixed values): to its pattern they are neither.
_NEWER = r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
_HAS_NEWER = re.compile(f"[{_NEWER}]")
_L, _N = (rf"(?:(?![{_NEWER}])\p{{{x}}})" for x in "LN")
_OLDER = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?{_L}+| ?{_N}+| ?(?:[{_NEWER}]|[^{_WS}\p{{L}}\p{{N}}])+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: White space beyond ASCII in UTF-8: such texts aren't cut into chunks.
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary.

    Bytes that print in Latin-1 stand for themselves, the others for the
    characters from 256 on, in order.
    """
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class ByteBpe:
    """Tables of one vocabulary file, and the worker's memo."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        chars = byte_characters()
        self.of_byte = np.array([vocab[c] for c in chars], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)[order]
        back = {c: b for b, c in enumerate(chars)}
        size = max([*vocab.values(), *self.special.values()]) + 1
        pieces = [b""] * size
        for token, i in vocab.items():
            pieces[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            pieces[i] = token.encode()
        self.piece_size = np.array([len(p) for p in pieces], np.int64)
        self.piece_start = np.cumsum(self.piece_size) - self.piece_size
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.memo = Memo(size)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, how many each word has)."""
        size = np.array([len(w) for w in words], np.int64)
        symbols = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        out_ids, out_word = [], []
        never = len(self.keys)
        while len(symbols):
            key = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), never - 1)
            known = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank = np.where(known, self.rank[at], never)
            head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            low = np.minimum.reduceat(np.append(rank, never), head)
            count = np.diff(np.append(head, len(symbols)))
            if (low == never).any():
                stays = np.repeat(low < never, count)
                out_ids.append(symbols[~stays])
                out_word.append(word[~stays])
                if not stays.any():
                    break
                low, count = low[low < never], count[low < never]
                symbols, word = symbols[stays], word[stays]
                rank, at = np.append(rank, never)[stays][:-1], np.append(at, 0)[stays][:-1]
            hit = rank == np.repeat(low, count)[:-1]
            # of overlapping places (runs of one symbol) every second one merges
            place = np.flatnonzero(hit)
            new = np.concatenate([[True], np.diff(place) > 1])
            start = place[new][np.cumsum(new) - 1]
            place = place[(place - start) % 2 == 0]
            symbols[place] = self.merged[at[place]]
            gone = np.ones(len(symbols), bool)
            gone[place + 1] = False
            symbols, word = symbols[gone], word[gone]
        if not out_ids:
            return np.empty(0, np.int64), np.zeros(len(words), np.int64)
        ids, owner = np.concatenate(out_ids), np.concatenate(out_word)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(words))

    def _words(self, text: str) -> list[list]:
        """The words of a text; special tokens stay whole, as their ids."""
        found: list = []
        for part in self.split.split(text) if self.split else [text]:
            if part in self.special:
                found.append(self.special[part])
            elif part:
                found.extend((_OLDER if not part.isascii() and _HAS_NEWER.search(part) else PATTERN).findall(part))
        return found

    def encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, how many each has), without the memo."""
        words = [self._words(t) for t in texts]
        distinct: dict[str, int] = {}
        number = [[-1 - w if isinstance(w, int) else distinct.setdefault(w, len(distinct)) for w in ws] for ws in words]
        ids, size = self.merge([w.encode() for w in distinct])
        begin = np.cumsum(size) - size
        flat = np.array([x for ws in number for x in ws], np.int64)
        special = flat < 0
        # special ids follow the merged ones in one table
        table = np.concatenate([ids, -1 - flat[special]])
        n = np.where(special, 1, size[np.maximum(flat, 0)] if len(size) else 1)
        first = np.where(special, len(ids) + np.cumsum(special) - 1, begin[np.maximum(flat, 0)] if len(size) else 0)
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        out = table[np.arange(total) + np.repeat(first - (ends - n), n)]
        per = np.bincount(np.repeat(np.arange(len(words)), [len(w) for w in words]), weights=n, minlength=len(words)).astype(np.int64)
        return out.astype(np.uint32), per

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of an Arrow array's texts in a row, how many each has)."""
        buf, offs = textbuf.flat(texts)
        raw = buf.tobytes()
        space = textbuf._SEP[buf]
        cut = np.zeros(len(buf), bool)
        cut[1:] = space[1:] & ~space[:-1]
        cut[offs[:-1][offs[:-1] < offs[1:]]] = True
        odd = [m.start() for m in _WIDE_SPACE.finditer(raw)]
        for token in self.special:
            odd += [m.start() for m in re.finditer(re.escape(token.encode()), raw)]
        for d in np.unique(np.searchsorted(offs, odd, "right") - 1).tolist() if odd else []:
            cut[offs[d] + 1 : offs[d + 1]] = False  # encoded whole
        begin = np.flatnonzero(cut)
        stop = np.append(begin[1:], len(buf))
        hashes = textbuf.span_hashes(buf, begin, stop)

        def unseen(at):
            ids, per = self.encode_plain([raw[i:j].decode() for i, j in zip(begin[at].tolist(), stop[at].tolist())])
            return per, ids

        ids, n = self.memo.lookup(hashes, unseen)
        bounds = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(begin, offs)]
        return ids, np.diff(bounds)

    def decode(self, ids: np.ndarray, per: np.ndarray) -> list[str]:
        """The text of each run of ids; bytes that are no UTF-8 become U+FFFD."""
        n = self.piece_size[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        raw = self.piece_bytes[np.arange(total) + np.repeat(self.piece_start[ids] - (ends - n), n)].tobytes()
        at = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per)])].tolist()
        return [raw[i:j].decode("utf-8", "replace") for i, j in zip(at[:-1], at[1:])]


_WORKERS: dict[str, ByteBpe] = {}


def worker(path: str) -> ByteBpe:
    """The tables of this Python worker."""
    if path not in _WORKERS:
        _WORKERS[path] = ByteBpe(path)
    return _WORKERS[path]


def _encode(path: str):
    def run(batches):
        bpe = worker(path)
        for b in textbuf.slices(batches, "text"):
            ids, per = bpe.encode(b.column("text"))
            yield pa.record_batch([b.column("doc_id"), textbuf.lists(per, pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return run


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids of each row; a null text has no ids."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_encode(path), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of each row of ids; null ids give an empty text."""

    def run(batches):
        bpe = worker(path)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                column = part.column("ids")
                per = column.value_lengths().fill_null(0).to_numpy().astype(np.int64)
                yield pa.record_batch([part.column("doc_id"), pa.array(bpe.decode(column.flatten().to_numpy().astype(np.int64), per))], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _round_trip(path: str):
    def run(batches):
        bpe = worker(path)
        for b in textbuf.slices(batches, "text"):
            ids, per = bpe.encode(b.column("text"))
            texts = bpe.decode(ids.astype(np.int64), per)
            raw = ids.astype("<u4").tobytes()
            at = (4 * np.concatenate([[0], np.cumsum(per)])).tolist()
            yield pa.record_batch(
                [b.column("doc_id"), pa.array(per), pa.array([hashlib.sha256(raw[i:j]).hexdigest() for i, j in zip(at[:-1], at[1:])]), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row.

    One row per input row, whatever its id; a null text is empty; an empty
    table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_round_trip(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
