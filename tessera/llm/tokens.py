"""Token ids of whole texts by a byte-level BPE of the tokenizers library: words that come again are looked up, plain words that are
new are merged together in numpy, all else goes to the library."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

#: White space that this module cuts at. Texts with any other white space go to the library whole.
CHUNK = re.compile("[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
ODD = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
LOOSE = re.compile("  |[\t\n\r] | [\t\n\r]|\n\n|^[ \n]| $")
#: A chunk of letters or digits that white space, at most a line feed, comes before and punctuation after: the pre-tokeniser cuts it into
#: these parts, and takes a space before the letters or digits into their part.
PLAIN = re.compile("(\x0b?)(\n?)([A-Za-zÀ-ÖØ-öø-ɏ]+|[0-9]+)([!-&(-/:-@[-`{-~]*)")
#: The only tokenizer whose merges this module knows: no normaliser, byte-level pre-tokeniser as GPT-2, BPE without options.
KNOWN = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
#: Words merged at once, and a rank that no pair has.
BLOCK, NEVER = 4096, np.iinfo(np.int32).max
#: Words kept for lookup in a worker; the store is emptied when it is full, which changes no result.
STORE = 800_000
STORE_CHARS = 64


class Merges:
    """The merges of a byte-level BPE, applied to many words at once."""

    def __init__(self, model: dict):
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, result = (np.array(x, np.int64) for x in zip(*[(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]))
        self.none = max(vocab.values()) + 1  # stands where a word has no symbol
        self.result = result.astype(np.int32)
        code = left * (self.none + 1) + right
        order = np.argsort(code, kind="stable")
        self.rank_of = np.append(order, NEVER).astype(np.int32)
        self.code = np.append(code[order], np.iinfo(np.int64).max)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        signs = {**{b: chr(b) for b in printable}, **{b: chr(256 + k) for k, b in enumerate(others)}}
        self.byte = np.array([vocab[signs[b]] for b in range(256)], np.int32)
        self.byte_rank = np.full((257, 257), NEVER, np.int32)  # by byte, 256 where a word has none
        self.byte_rank[:256, :256] = self.ranks(self.byte[:, None], self.byte[None, :])

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = left.astype(np.int64) * (self.none + 1) + right
        at = np.searchsorted(self.code, code)
        return np.where(self.code[at] == code, self.rank_of[at], NEVER)

    def __call__(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word: the pair of least rank, the leftmost of equals, is merged until none is left."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        out = [b""] * len(words)
        for lo in range(0, len(words), BLOCK):
            at = order[lo:lo + BLOCK]
            width = size[at[-1]]
            data = np.full((len(at), width + 2), 256, np.int16)
            data[:, 1:-1][np.arange(width) < size[at][:, None]] = np.frombuffer(b"".join([words[k] for k in at.tolist()]), np.uint8)
            ids = np.append(self.byte, np.int32(self.none))[data]
            rank = self.byte_rank[data[:, :-1], data[:, 1:]]
            while len(at):
                row = np.arange(len(at))
                p = rank.argmin(axis=1)
                best = rank[row, p]
                done = best == NEVER
                if done.any():
                    rest = ids[done]
                    has = rest != self.none
                    data, end = rest[has].astype("<u4").tobytes(), 4 * np.cumsum(has.sum(axis=1))
                    for k, a, b in zip(at[done].tolist(), [0, *end.tolist()], end.tolist()):
                        out[k] = data[a:b]
                    live = ~done
                    at, ids, rank, p, best = at[live], ids[live], rank[live], p[live], best[live]
                    row = row[:len(at)]
                if not len(at):
                    break
                q = p[:, None]
                ids = np.where(np.arange(ids.shape[1] - 1) > q, ids[:, 1:], ids[:, :-1])
                rank = np.where(np.arange(rank.shape[1] - 1) >= q, rank[:, 1:], rank[:, :-1])
                ids[row, p] = now = self.result[best]
                rank[row, p - 1] = self.ranks(ids[row, p - 1], now)  # no pair begins at 0, where no symbol is
                rank[row, p] = self.ranks(now, ids[row, p + 1])
        return out


class Encoder(dict):
    """text -> little-endian unsigned 32-bit ids, equal to the library's ``encode(text, add_special_tokens=False)``.

    The byte-level pre-tokeniser never joins a non-space character with white space that follows it, so a text may be
    cut there and its chunks encoded alone. A key without leading white space stands for that word after one space, a key after
    a vertical tab for what follows it, without a space.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.parts: dict[str, bytes] = {}  # line feeds and punctuation behind words
        with open(path, encoding="utf-8") as file:
            form = json.load(file)
        model, cut = form["model"], form["pre_tokenizer"] or {}
        odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        known = (model["type"] == "BPE" and not any(model.get(k) for k in odd) and not form["normalizer"]
                 and {k: cut.get(k) for k in KNOWN} == KNOWN)
        self.merges = Merges(model) if known and model["merges"] else None

    def whole(self, text: str) -> bytes:
        return b"".join(map(self.id_bytes.__getitem__, self.tokenizer.encode(text, add_special_tokens=False).ids))

    def part(self, text: str) -> bytes:
        if text not in self.parts:
            if len(self.parts) > STORE_CHARS * STORE_CHARS:
                self.parts.clear()
            self.parts[text] = self.whole(text) if text else b""
        return self.parts[text]

    def learn(self, keys: set[str]) -> dict[str, bytes]:
        """Encode chunks that are not in the store, and keep the short ones."""
        if len(self) + len(keys) > STORE:
            self.clear()
        new, words, plain, other = {}, [], [], []
        for k in keys:
            if not self.merges or len(k) > STORE_CHARS:
                other.append(k)
            elif k.isascii() and k.isalpha():
                words.append(k)
            elif m := PLAIN.fullmatch(k):
                bare, line, word, tail = m.groups()
                if line or tail:
                    plain.append((k, self.part(line), "\x0b" + word if bare or line else word, self.part(tail)))
                else:
                    words.append(k)
            else:
                other.append(k)
        if words or plain:
            words += {w for _, _, w, _ in plain if w not in self and w not in keys}
            new.update(zip(words, self.merges([w[1:].encode() if w[0] == "\x0b" else b" " + w.encode() for w in words])))
            for k, line, word, tail in plain:
                new[k] = line + (new.get(word) or self[word]) + tail
        if other:
            texts = [k[1:] if k[0] == "\x0b" else k if k[0] in " \t\n\r" else " " + k for k in other]
            at = self.id_bytes.__getitem__
            for k, e in zip(other, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                new[k] = b"".join(map(at, e.ids))
        self.update(new if max(map(len, keys)) <= STORE_CHARS else
                    {k: v for k, v in new.items() if len(k) <= STORE_CHARS})
        return new

    def chunks(self, text: str) -> list[str] | None:
        """Keys of the chunks of a text, None if it goes to the library whole."""
        if any(s in text for s in self.special) or ODD.search(text):
            return None
        if text[0] in " \n" or text[-1] == " " or "  " in text or "\n\n" in text or "\n " in text or " \n" in text or (
                ("\t" in text or "\r" in text) and LOOSE.search(text)):
            chunks = [c[1:] if len(c) > 1 and c[0] == " " and c[1] not in " \t\n\r" else c
                      for c in CHUNK.findall(text)]
            chunks[0] = "\x0b" + CHUNK.match(text).group()
        else:
            chunks = text.replace("\n", " \n").split(" ")
            chunks[0] = "\x0b" + chunks[0]
        return chunks

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Each text's ids; what the texts hold that is new is learned at once."""
        out: list[bytes] = []
        gaps, new = [], set()
        for k, text in enumerate(texts):
            chunks = self.chunks(text) if text else []
            if chunks is None:
                out.append(self.whole(text))
                continue
            found = list(map(self.get, chunks))
            if None in found:
                missing = [c for c, f in zip(chunks, found) if f is None]
                new.update(missing)
                gaps.append((k, found, missing))
                out.append(b"")
            else:
                out.append(b"".join(found))
        if gaps:
            learned = self.learn(new)
            for k, found, missing in gaps:
                more = iter(missing)
                out[k] = b"".join([learned[next(more)] if f is None else f for f in found])
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


@lru_cache(1)
def encoder_of(path: str) -> Encoder:
    return Encoder(path)
