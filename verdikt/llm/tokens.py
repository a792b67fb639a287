"""Token ids of whole texts by a public tokenizer, many texts at a time.

``Ids`` gives exactly the ids of ``tokenizers`` for any of its files. For the kind that lower-cases, splits letters, single
digits and other characters apart and marks word ends, most texts take a shorter way: the characters of a block are
classed in one array, ``END_MARK`` is put behind each word, and one call of a byte-pair encoder that holds the same merges
encodes the block. A mark is part of a word's last symbol, so words, and so texts, are found again in the ids.

Texts go to ``tokenizers`` itself if they hold a special token's name, ``END_MARK``, a character that changes under NFC, one
whose lower case isn't one character of its own, or one that Unicode versions class in different ways. Texts of any length
are encoded in slices that end at white space, which the tokenizer never joins.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np

#: Characters of a text that are encoded at a time.
SLICE = 1 << 20
END_MARK = "\x01"
#: The normaliser and the split of the kind of tokenizer that takes the shorter way.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACE = re.compile(r"\s")
OTHER, LETTER, DIGIT, SPACE, UNSAFE = range(5)
_CODES = 0x20000


def _byte_letters() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes with."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def _class_of(code: int) -> int:
    c = chr(code)
    if c.isspace() and not 0x1C <= code <= 0x1F:
        return SPACE
    kind = unicodedata.category(c)
    if c == END_MARK or kind in ("Cn", "Cs") or c in "Σς" or len(c.lower()) > 1:
        return UNSAFE
    if kind[0] in "LN":
        # letters and numbers that came with later versions may be unknown to the tokenizer's tables
        if unicodedata.ucd_3_2_0.category(c)[0] != kind[0]:
            return UNSAFE
        return LETTER if kind[0] == "L" else DIGIT
    return OTHER


class WordEncoder:
    """Byte pair encoding of words with end marks, from the tokenizer's own merges.

    The merges are ranked byte strings; the mark's one byte stands for the word's end, and a last byte with its mark is a
    symbol from the start. ``ids`` holds the tokenizer's id of each rank, ``ends`` whether it ends a word.
    """

    def __init__(self, model: dict) -> None:
        import tiktoken

        letters, mark = _byte_letters(), END_MARK.encode()

        def raw(token: str) -> bytes:
            word = token.removesuffix("</w>")
            return bytes(letters[c] for c in word) + (mark if token != word else b"")

        ranks = {bytes([b]): b for b in range(256)} | {bytes([b]) + mark: 256 + b for b in range(256)}
        for pair in model["merges"]:
            ranks.setdefault(raw("".join(pair.split(" ") if isinstance(pair, str) else pair)), len(ranks))
        self.ids, self.ends = np.zeros(len(ranks) + 1, "<u4"), np.zeros(len(ranks) + 1, bool)
        for word, rank in ranks.items():
            self.ends[rank] = len(word) > 1 and word.endswith(mark)
        for token, i in model["vocab"].items():
            if not token.startswith("<|") and (rank := ranks.get(raw(token))) is not None:
                self.ids[rank] = i
        # a special token that no text can hold keeps the encoder's search for such tokens short
        self.encoding = tiktoken.Encoding("words", pat_str=f"[^{END_MARK}]*{END_MARK}", mergeable_ranks=ranks, special_tokens={END_MARK * 3: len(ranks)})

    def __call__(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=())


def _shortcut(spec: dict) -> bool:
    """Whether the file is of the kind that the module's docstring describes."""
    model, normal, pre = spec["model"], spec.get("normalizer") or {}, (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = pre[0] if len(pre) == 2 else {}
    return (
        model.get("type") == "BPE"
        and model.get("end_of_word_suffix") == "</w>"
        and not model.get("dropout")
        and [x["type"] for x in normal.get("normalizers", [])] == NORMALIZERS
        and split.get("pattern") == {"Regex": PATTERN}
        and split.get("behavior") == "Removed"
        and split.get("invert") is True
        and pre[1] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    )


def marked(code: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters without white space and with a mark behind each word, and at which characters words end."""
    n = len(code)
    end = np.empty(n, bool)
    end[-1:] = True
    np.not_equal(kind[1:], kind[:-1], out=end[:-1])
    end |= kind == DIGIT
    # 's, 't, 're, 've, 'm, 'll, 'd are words where the apostrophe follows no other mark
    at = np.flatnonzero(code == 0x27)
    if len(at):
        at = at[(at == 0) | (kind[at - 1] != OTHER)]
        a, b = (np.where(at + k < n, code[np.minimum(at + k, n - 1)], 0) for k in (1, 2))
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        end[at[one | two]] = False
        end[at[one] + 1] = True
        end[at[two] + 2] = True
    end &= kind != SPACE
    times = (kind != SPACE).astype(np.int8) + end
    out = np.repeat(code, times)
    out[np.cumsum(times, dtype=np.int64)[end] - 1] = ord(END_MARK)
    return out, end


class Ids:
    """Token ids of texts as little-endian unsigned 32-bit arrays."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.words = WordEncoder(spec["model"]) if _shortcut(spec) else None
        if self.words:
            self.kind = np.full(0x110000, UNSAFE, np.uint8)
            self.kind[:_CODES] = [_class_of(c) for c in range(_CODES)]

    def _slow(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that together are some MB at most."""
        if self.words is None:
            return self._slow(texts)
        safe = [not any(s in t for s in self.special) and (t.isascii() or unicodedata.is_normalized("NFC", t)) for t in texts]
        low = [t.lower() if s else "" for t, s in zip(texts, safe, strict=True)]
        sizes = np.array([len(t) + 1 for t in low])
        border = np.cumsum(sizes)
        # before lower-casing a character may be unsafe, after it no longer
        before = np.frombuffer("\n".join([*(t if s else "" for t, s in zip(texts, safe, strict=True)), ""]).encode("utf-32-le"), np.uint32)
        code = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le"), np.uint32)
        unsafe = self.kind[code] == UNSAFE
        if len(before) == len(code):
            unsafe |= self.kind[before] == UNSAFE
            bad = np.unique(np.searchsorted(border, np.flatnonzero(unsafe), "right"))
        else:
            bad = np.array([k for k, (t, s) in enumerate(zip(texts, safe, strict=True)) if s and (self.kind[np.frombuffer(t.encode("utf-32-le"), np.uint32)] == UNSAFE).any()], np.int64)
        slow = np.array([not s for s in safe])
        slow[bad] = True
        if slow.any():
            code = code.copy()
            for k in np.flatnonzero(slow):
                code[border[k] - sizes[k] : border[k]] = 10
        text, end = marked(code, self.kind[code])
        ranks = self.words(text.tobytes().decode("utf-32-le"))
        words = np.concatenate([[0], np.cumsum(end)])[np.concatenate([[0], border])]
        ends = np.concatenate([[0], np.flatnonzero(self.words.ends[ranks]) + 1])
        if len(ends) != words[-1] + 1:
            raise RuntimeError("words and ids don't agree")
        ids, at = self.words.ids[ranks], ends[words]
        out = [ids[a:z] for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        for k, own in zip(np.flatnonzero(slow).tolist(), self._slow([texts[k] for k in np.flatnonzero(slow)]), strict=True):
            out[k] = own
        return out

    def of(self, texts: list[str]) -> list[np.ndarray]:
        if sum(map(len, texts)) <= SLICE:
            return self._encode(texts) if texts else []
        out = []
        for t in texts:
            parts, at = [], 0
            while at < len(t):
                gap = _SPACE.search(t, min(at + SLICE, len(t)))
                end = gap.start() if gap else len(t)
                parts += self._encode([t[at:end]])
                at = end
            out.append(np.concatenate(parts) if parts else np.zeros(0, "<u4"))
        return out
