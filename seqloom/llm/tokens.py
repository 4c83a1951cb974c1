"""Token ids of whole texts, by a public tokenizer file."""

from __future__ import annotations

import os
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Space between two characters that are not white space: no pre-token ever spans it.
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Letters, then nothing or other visible characters that are no digits, on one line or two.
_PARTS = re.compile(r"([^\W\d_]+)([!#-&(-/:-@\[-`{-~]*)(?:\n([^\W\d_]+)([!#-&(-/:-@\[-`{-~]*))?")
_DOUBLE = re.compile(r"\s\s")
_DOUBLE_SPACE = "  "
_OTHER_ASCII = ("\n ", " \n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f")


def _near_other_space(text: str) -> bool:
    """Whether a space may stand next to other white space."""
    if text.isascii():
        return any(x in text for x in _OTHER_ASCII)
    return _DOUBLE.search(text) is not None


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


class TextEncoder:
    """Encodes texts with a byte-level BPE of the tokenizers library.

    Its pre-tokens end before a single space, so the ids of a text are the ids of its space-separated
    pieces in a row. Pieces repeat: their ids are kept, up to ``limit`` pieces, as little-endian
    unsigned 32-bit integers.
    """

    def __init__(self, path: str, limit: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        self.line = np.array(self.tokenizer.encode("\n", add_special_tokens=False).ids, dtype="<u4").tobytes()
        self.marks: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}

    def _learn(self, known: dict[str, bytes], pieces: list[str], prefix: str) -> None:
        """Learn the ids of ``pieces`` after ``prefix``; for " ", what follows letters is looked up on its own."""
        parts: list[tuple] = []
        if prefix and pieces:
            stems = {p for p in pieces if p.isalpha()}
            rest = [p for p in pieces if p not in stems]
            found = list(map(_PARTS.fullmatch, rest))
            parts = [m.group(0, 1, 2, 3, 4) for m in found if m]
            rest = [p for p, m in zip(rest, found) if not m]
            # a run of letters, the marks behind it and a line feed are pre-tokens of their own
            stems.update({x[1] for x in parts}.difference(known))
            heads = {x[3] for x in parts if x[3]}.difference(self.plain)
            tails = {t for x in parts for t in (x[2], x[4]) if t}.difference(self.marks)
            self._learn(self.plain, list(heads), "")
            self._learn(self.marks, list(tails), "")
            pieces = self._learn_joined(known, [*stems, *rest])
        found = self.tokenizer.encode_batch_fast([prefix + p for p in pieces], add_special_tokens=False)
        for p, e in zip(pieces, found):
            known[p] = struct.pack(f"<{len(e.ids)}I", *e.ids)
        for p, stem, tail, head, last in parts:
            data = known[stem] + self.marks[tail] if tail else known[stem]
            if head:
                data += self.line + self.plain[head]
            known[p] = data + self.marks[last] if last else data

    def _learn_joined(self, known: dict[str, bytes], pieces: list[str]) -> list[str]:
        """Encode words as one text, where ids that begin with a space open the next; returns the rest."""
        plain, rest = [], []
        for p in pieces:
            (plain if p.isalpha() or p and p.isprintable() and " " not in p and "<|" not in p else rest).append(p)
        for lo in range(0, len(plain), 4096):
            some = plain[lo: lo + 4096]
            ids = self.tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids
            ids = np.array(ids, dtype="<u4")
            at = np.flatnonzero(self.opens[ids])
            if len(at) != len(some):  # another kind of tokenizer
                return pieces
            data, at = ids.tobytes(), (at * 4).tolist()
            known.update(zip(some, (data[i:j] for i, j in zip(at, [*at[1:], len(data)]))))
        return rest

    def encode(self, texts: list[str | None], end: bytes) -> list[bytes]:
        """The ids of each text, null counting as empty, followed by ``end``."""
        out: list[bytes] = []
        some: list[str] = []
        held = 0
        for text in texts:  # pieces of about four million characters at a time
            some.append(text or "")
            held += len(some[-1])
            if held >= 1 << 22:
                out += self._encode(some, end)
                some, held = [], 0
        return out + self._encode(some, end)

    def _encode(self, texts: list[str], end: bytes) -> list[bytes]:
        if len(self.spaced) > self.limit:
            self.spaced.clear()
        for known in (self.plain, self.marks):
            if len(known) > self.limit:
                known.clear()
        odd = [i for i, text in enumerate(texts) if _DOUBLE_SPACE in text or text[:1] == " " or text[-1:] == " "
               or _near_other_space(text)]
        out: list[bytes] = [b""] * len(texts)
        for i in odd:
            pieces = _CUT.split(texts[i])
            parts = [p[1:] for p in pieces[1:]]
            self._learn(self.plain, list({pieces[0]}.difference(self.plain)), "")
            self._learn(self.spaced, list(set(parts).difference(self.spaced)), " ")
            out[i] = self.plain[pieces[0]] + b"".join(map(self.spaced.__getitem__, parts)) + end
        skip = set(odd)
        rows = [i for i in range(len(texts)) if i not in skip]
        if rows:
            for i, data in zip(rows, self._encode_words([texts[i] for i in rows])):
                out[i] = data + end
        return out

    def _encode_words(self, texts: list[str]) -> list[bytes]:
        """Ids of texts whose words are one space apart: different words are looked up once, ids gathered by word."""
        cut = pc.split_pattern(pa.array(texts, pa.string()), " ")
        begin = cut.offsets.to_numpy().astype(np.int64)
        found = cut.flatten().dictionary_encode()
        different, at = found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy().astype(np.int64)
        first = [different[i] for i in at[begin[:-1]].tolist()]
        # the first word of a text follows no space
        at[begin[:-1]] = len(different) + np.arange(len(texts))
        self._learn(self.plain, list(set(first).difference(self.plain)), "")
        data = list(map(self.spaced.get, different))
        new = [i for i, x in enumerate(data) if x is None]
        self._learn(self.spaced, [different[i] for i in new], " ")
        for i in new:
            data[i] = self.spaced[different[i]]
        data.extend(map(self.plain.__getitem__, first))
        size = np.fromiter(map(len, data), np.int64, len(data)) // 4
        start = np.cumsum(size) - size
        n = size[at]
        ends = np.cumsum(n)
        ids = np.frombuffer(b"".join(data), "<u4")[np.repeat(start[at] - ends + n, n) + np.arange(ends[-1])]
        bounds = np.concatenate([[0], ends])[begin].tolist()
        return [ids[i:j].tobytes() for i, j in zip(bounds, bounds[1:])]


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]
