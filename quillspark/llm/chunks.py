"""Token ids of texts by a memo over the parts between blanks."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A run of white space with the run after it, or the white space that ends a text.
CHUNK = re.compile(r"\s*\S+|\s+")
#: re counts these as white space; Unicode's property, by which tokenizers split, doesn't.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")


class Memo:
    """Encodes texts part by part; each distinct part is encoded once while it is remembered.

    The pattern `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`
    never matches across the end of a run of non-space, and looks one character ahead at most.
    So the ids of a text are those of its chunks (CHUNK), one after another. Where single blanks part a text
    (no part between blanks is empty or begins or ends with white space), the parts with the blank before are
    such chunks or several of them, and splitting is cheap; other texts are cut by CHUNK.
    encode takes chunks and returns each one's ids as bytes of little-endian 32-bit integers. Parts that end in
    a full stop or comma after a letter share the ids of the part without it, since the sign is a token of its own.
    The memo is emptied when it holds `limit` parts: memory is bounded, and results don't depend on it.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = 1 << 19, long: int = 48, apart: tuple[str, ...] = ()):
        """Texts that hold one of `apart` (tokens that the tokenizer takes out first) are encoded whole."""
        self.encode, self.limit, self.long, self.apart, self.known = encode, limit, long, apart, {}
        self.signs = dict(zip(".,", encode([".", ","]), strict=True))

    def __call__(self, text: str) -> np.ndarray:
        """Ids as 32-bit integers."""
        if any(c in text for c in (*_ODD, *self.apart)):
            return np.frombuffer(self.encode([text])[0], "<i4")
        head, *parts = text.split(" ")
        raw = self._of_parts(parts)
        if raw is None or head[-1:].isspace():
            raw, head = b"".join(self.encode(CHUNK.findall(text))), ""
        first = b"".join(self.encode(CHUNK.findall(head))) if head else b""
        return np.frombuffer(first + raw, "<i4")

    def _of_parts(self, parts: list[str]) -> bytes | None:
        """Ids of the parts, each with a blank before; None if they aren't parted by single blanks."""
        known = self.known
        ids = list(map(known.get, parts))
        if None not in ids:
            return b"".join(ids)
        new = {p for p, i in zip(parts, ids, strict=True) if i is None}
        if any(not p or p[0].isspace() or p[-1].isspace() for p in new):
            return None
        found = self._learn(new)
        return b"".join([found[p] if i is None else i for p, i in zip(parts, ids, strict=True)])

    def _learn(self, new) -> dict[str, bytes]:
        """Ids of distinct parts that aren't remembered, with a blank before each; what isn't long is remembered."""
        known = self.known
        if len(known) > self.limit:
            known.clear()
        stems: dict[str, None] = {}
        whole: dict[str, list[str]] = {}
        for p in new:
            if "\n" in p:
                whole[p] = CHUNK.findall(" " + p)
                continue
            q = p[:-1] if p[-1] in ".," and p[-2:-1].isalpha() else p
            if q not in known:
                stems[q] = None
        found = dict(zip(stems, self.encode([" " + q for q in stems]), strict=True))
        for p, chunks in whole.items():
            found[p] = b"".join(self.encode(chunks))
        for p in new:
            if p not in found:
                q = p[:-1]
                found[p] = known[p] if p in known else (found.get(q) or known[q]) + self.signs[p[-1]]
        known.update(x for x in found.items() if len(x[0]) <= self.long)
        return found

    def batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after another; where each text's begin, one more at the end); null is empty.

        The parts of many texts are numbered at once, so that Python sees each distinct one once.
        """
        column = pc.fill_null(column.cast(pa.large_string()), "")
        lists = pc.split_pattern(column, " ")
        offs = np.asarray(lists.offsets).astype(np.int64)
        coded = lists.values.slice(offs[0], offs[-1] - offs[0]).dictionary_encode()
        offs = offs - offs[0]
        which, parts = np.asarray(coded.indices), coded.dictionary.to_pylist()
        raw = list(map(self.known.get, parts))
        new = [k for k, x in enumerate(raw) if x is None]
        odd = np.zeros(len(parts), bool)  # what is remembered has no white space around it
        odd[[k for k in new if not parts[k] or parts[k][0].isspace() or parts[k][-1].isspace()]] = True
        odd = odd[which]
        odd[offs[:-1]] = False  # a text's first part is looked at by itself
        bad = np.add.reduceat(odd, offs[:-1]) > 0 if len(column) else np.zeros(0, bool)
        for sign in (*_ODD, *self.apart):
            bad |= np.asarray(pc.match_substring(column, sign).to_numpy(zero_copy_only=False), bool)
        texts = {i: self(x) for i, x in zip(np.flatnonzero(bad).tolist(), column.filter(pa.array(bad)).to_pylist(), strict=True)}
        heads = {}
        for i in np.flatnonzero(~bad).tolist():
            head = parts[which[offs[i]]]
            if head[-1:].isspace():
                texts[i] = self(column[i].as_py())
            elif head:
                heads[i] = self.encode(CHUNK.findall(head))
        # ids of the distinct parts that some plain text has after its first
        plain = np.ones(len(column), bool)
        plain[list(texts)] = False
        body = np.repeat(plain, np.diff(offs))
        body[offs[:-1]] = False
        used = np.zeros(len(parts), bool)
        used[which[body]] = True
        new = [k for k in new if used[k]]
        for k, x in zip(new, self._each([parts[k] for k in new]), strict=True):
            raw[k] = x
        raw = [x or b"" for x in raw]
        flat = np.frombuffer(b"".join(raw), "<i4")
        size = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        start = (np.cumsum(size) - size).astype(np.int32)  # ids of one column are far fewer than 2 ** 31
        # lengths of texts, then every text's ids are put in place
        words = np.where(body, size[which], 0)
        ends = np.concatenate([[0], np.cumsum(words)])
        first = {i: np.frombuffer(b"".join(h), "<i4") for i, h in heads.items()} | texts
        length = ends[offs[1:]] - ends[offs[:-1]]
        ahead = np.zeros(len(column), np.int64)
        for i, x in first.items():
            ahead[i] = len(x)
        begins = np.concatenate([[0], np.cumsum(length + ahead)])
        out = np.empty(begins[-1], "<i4")
        for i, x in first.items():
            out[begins[i] : begins[i] + len(x)] = x
        run = np.flatnonzero(words)
        n = words[run]
        text = np.repeat(np.arange(len(column)), np.diff(offs))[run]
        to = (ends[run] - ends[offs[text]] + begins[text] + ahead[text]).astype(np.int32)
        step = np.arange(n.sum(), dtype=np.int32) - np.repeat((np.cumsum(n) - n).astype(np.int32), n)
        out[np.repeat(to, n) + step] = flat[np.repeat(start[which[run]], n) + step]
        return out, begins

    def _each(self, parts: list[str]) -> list[bytes]:
        """Ids of each of some distinct parts with a blank before."""
        out: list[bytes] = []
        for lo in range(0, len(parts), 4096):
            found = self._learn(parts[lo : lo + 4096])
            out += [found[p] for p in parts[lo : lo + 4096]]
        return out
