"""Byte-pair encoding as a bounded-lookahead streaming transducer, and its streaming inverse.

An encoding of a word under a ranked merge list is valid exactly when every two neighbouring tokens, joined and encoded
alone, give those same two tokens. So each prefix of the input has one last token, found from the prefixes before it,
and the encoding of any continuation runs through one of the last ``lookahead`` prefixes, where ``lookahead`` is the
length of the longest token that the merge list builds. Tokens on which all those live prefixes agree can never change:
they are emitted and forgotten, so the state stays at a few ``lookahead`` entries however long the input is.
"""

from __future__ import annotations

import base64
import codecs

import regex

#: Fixed value: the pattern that splits text before the merges of the public 50k byte vocabulary.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts up to this length are split all at once, longer ones word by word.
CHUNK_CHARS = 1 << 16
CACHE_WORDS = 1 << 18


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Parse a rank file: one base64 token and its rank per line."""
    out = {}
    for line in data.splitlines():
        if line:
            token, rank = line.split()
            out[base64.b64decode(token)] = int(rank)
    return out


class Transducer:
    """Encoder over one merge list. Memory: a bounded word cache, a bounded pair memo, and the live window."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.lookahead = max(map(len, ranks), default=1)
        #: by first byte pair, the longest token beginning so: bounds the candidate lengths at each position
        self.reach: dict[bytes, int] = {}
        for t in ranks:
            k = t[-2:]
            if len(t) > self.reach.get(k, 0):
                self.reach[k] = len(t)
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.words: dict[str, list[int]] = {}
        self.split = regex.compile(SPLIT_PATTERN)

    def _merged_to(self, left: bytes, right: bytes) -> bool:
        """Whether the merge list, run on ``left + right``, ends with exactly these two tokens."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is not None:
            return known
        ranks, parts = self.ranks, [bytes((b,)) for b in left + right]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        good = parts == [left, right]
        if len(self.pairs) >= 4 * CACHE_WORDS:
            self.pairs.clear()
        self.pairs[key] = good
        return good

    def stream(self, pieces):
        """Token ids of one pre-split word that arrives in byte pieces; yields each id once it is stable."""
        ranks, reach, look = self.ranks, self.reach, self.lookahead
        window = bytearray()  # bytes after the last emitted token
        last: list[bytes] = [b""]  # last[i]: last token of the encoding of window[:i]
        tail = b""  # the token emitted last
        for piece in pieces:
            for byte in piece:
                window.append(byte)
                n = len(window)
                longest = min(n, reach.get(bytes(window[n - 2 : n]), 1)) if n > 1 else 1
                for size in range(longest, 0, -1):
                    token = bytes(window[n - size : n])
                    if token not in ranks:
                        continue
                    before = last[n - size] if n > size else tail
                    if n > size and not before:
                        continue
                    if not before or self._merged_to(before, token):
                        last.append(token)
                        break
                else:
                    last.append(b"")  # no encoding ends here under the tokens already emitted
                if n >= 4 * look and n % look == 0:
                    keep = self._stable(last, n)
                    at = 0
                    for token in keep:
                        at += len(token)
                        tail = token
                        yield ranks[token]
                    if at:
                        del window[:at]
                        last = [b"", *last[at + 1 :]]
        out, at = [], len(window)
        while at:
            out.append(last[at])
            at -= len(last[at])
        for token in reversed(out):
            yield ranks[token]

    def _stable(self, last: list[bytes], n: int) -> list[bytes]:
        """The tokens shared by the encodings of all live prefixes."""
        common: list[bytes] | None = None
        for end in range(n - self.lookahead + 1, n + 1):
            if not last[end]:
                continue
            chain, at = [], end
            while at:
                chain.append(last[at])
                at -= len(last[at])
            chain.reverse()
            if common is None:
                common = chain
            else:
                k = 0
                while k < len(common) and k < len(chain) and common[k] == chain[k]:
                    k += 1
                common = common[:k]
            if not common:
                return []
        return common or []

    def word(self, text: str) -> list[int]:
        """Ids of one pre-split word; short words are remembered in a bounded cache."""
        got = self.words.get(text)
        if got is None:
            data = text.encode("utf-8", "surrogatepass")
            got = [self.ranks[data]] if data in self.ranks else list(self.stream((data,)))
            if len(text) <= 64:
                if len(self.words) >= CACHE_WORDS:
                    self.words.clear()
                self.words[text] = got
        return got

    def encode(self, text: str | None, chunk: int = CHUNK_CHARS) -> list[int]:
        """Ids of a whole text, without special tokens; null and empty text give the empty list. Words are taken one at a
        time in reading order; a word without end, such as a line of one letter, goes through the transducer in pieces."""
        if not text:
            return []
        out: list[int] = []
        if len(text) <= chunk:
            known = self.words
            for w in self.split.findall(text):
                out.extend(known.get(w) or self.word(w))
            return out
        for m in self.split.finditer(text):
            out.extend(self.word(m.group()))
        return out


class Decoder:
    """Incremental byte-to-text machine: ids in, characters out as soon as their bytes are complete."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = {i: t for t, i in ranks.items()}

    def decode(self, ids) -> str:
        machine = codecs.getincrementaldecoder("utf-8")(errors="surrogatepass")
        return "".join(machine.decode(self.tokens[int(i)]) for i in ids) + machine.decode(b"", True)
