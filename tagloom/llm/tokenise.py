"""Encoding with a tokenizers file, sped up by remembering the ids of words.

Texts are cut where the tokenizer's own splitting rule certainly has a boundary, and the
ids of each cut word are kept, so most words cost a dictionary lookup. The rule is read
from the tokenizer file:

- byte-level splitting without a normaliser: before a single space and before a single line
  feed between two characters that are no white space ("spaced"; a space belongs to what follows);
- splitting that drops white space, after NFC, white-space collapsing and lower-casing:
  at every space and line feed ("dropped");
- anything else: no cuts, each text is encoded whole.

A worker process keeps its encoder from task to task (see shared()), so what one task has met
the next ones know. Strings of special tokens in a text become their ids, as by the library's own
setting; with ``plain`` they are ordinary text. Texts that may hold one are encoded whole by the
library. Null is the empty text. Memory: at most two generations of ``memo`` words, whatever the corpus, and the words of
CHUNK characters; longer texts are cut at such boundaries too.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain, compress, count, pairwise, repeat
from operator import is_
from typing import TypeVar

import numpy as np

T = TypeVar("T")
LONG_WORD, MEMO, CHUNK, GROUP = 64, 400_000, 1 << 20, 200
_INSIDE = re.compile(r"(?<=\S) (?=\S)")
#: Latin letters beyond ASCII that are one letter in lower case too.
_LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
_MARKS = ".,;:!?"
_held: dict[tuple, object] = {}


class _Memo:
    """The ids of pieces of text, two generations of at most limit pieces each."""

    def __init__(self, limit: int, learn):
        self.limit, self.learn = limit, learn
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def look(self, lists: list[list[str]]) -> list[bytes | None]:
        """The ids of each list of pieces; None for a list with a piece that can't be cut out."""
        pieces = list(chain.from_iterable(lists))
        found = list(map(self.young.get, pieces))
        lacking = list(compress(count(), map(is_, found, repeat(None))))
        if lacking:
            known = self._meet({pieces[i] for i in lacking})
            for i in lacking:
                found[i] = known.get(pieces[i])
        out, a = [], 0
        for n in map(len, lists):
            try:
                out.append(b"".join(found[a : a + n]))
            except TypeError:  # a piece has no ids of its own
                out.append(None)
            a += n
        return out

    def _meet(self, pieces: set[str]) -> dict[str, bytes]:
        known: dict[str, bytes] = {}
        fresh, long = [], []
        for p in pieces:
            ids = self.old.get(p)
            if ids is not None:
                known[p] = ids
            elif len(p) <= LONG_WORD:
                fresh.append(p)
            else:
                long.append(p)
        known.update(self.learn(fresh))
        if len(self.young) + len(known) > self.limit:
            self.old, self.young = self.young, {}
        self.young.update(known)
        for p in long:
            known.update(self.learn([p]))
        return known


def cutting_rule(spec: dict) -> str | None:
    """"spaced", "dropped" or None for the normaliser and the splitting of a tokenizer file."""
    before, pre = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
    if before is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "spaced"
    steps = [x.get("type") for x in (before or {}).get("normalizers", [])]
    splits = pre.get("pretokenizers") or [{}]
    if steps == ["NFC", "Replace", "Lowercase"] and splits[0].get("type") == "Split" and splits[0].get("behavior") == "Removed" and splits[0].get("invert") and all(not x.get("use_regex") and not x.get("add_prefix_space") for x in splits[1:]):
        return "dropped"
    return None


def _segments(text: str, between: re.Pattern) -> Iterator[str]:
    """The text in segments of about CHUNK characters, without the spaces between them."""
    start = 0
    while cut := len(text) - start > CHUNK and between.search(text, start + CHUNK):
        yield text[start : cut.start()]
        start = cut.end()
    yield text[start:]


class Encoder:
    """ids(text) of one tokenizer file, as unsigned 16-bit integers if its ids fit, else 32-bit."""

    def __init__(self, file: bytes, memo: int = MEMO, plain: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_buffer(file)
        self.tokenizer.encode_special_tokens = plain
        self.vocab = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.vocab <= 1 << 16 else "<u4")
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (plain and t.special)]
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        lead = os.path.commonprefix(added)
        self.lead = lead if lead.upper() == lead.lower() else ""
        parts = {name: getattr(self.tokenizer, name) for name in ("normalizer", "pre_tokenizer")}
        self.rule = cutting_rule({name: json.loads(part.__getstate__()) for name, part in parts.items() if part is not None})
        self.mark = self.whole({"spaced": "\n", "dropped": "~"}.get(self.rule, ""))
        if self.rule and len(self.mark) != 1:
            self.rule = None
        self.memo = _Memo(memo, self._learn)
        if self.rule:
            self.bare = Tokenizer(self.tokenizer.model)
            self.bare.pre_tokenizer = WhitespaceSplit()
            visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
            self.visible = dict(zip([b for b in range(256) if b not in visible], map(chr, range(256, 512)))) | {32: " "}
            end = self.bare.model.end_of_word_suffix or ""
            self.lengths = np.zeros(self.vocab, np.int64)
            for token, i in self.bare.get_vocab(with_added_tokens=False).items():
                self.lengths[i] = len(token.removesuffix(end))
            self.line = "\u010a" if self.rule == "spaced" else "~"  # the mark as the bare tokenizer sees it
            self.marks = {c: self.whole(c).tobytes() for c in _MARKS}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _between_marks(self, text: str, bare: bool = False) -> list[bytes]:
        """The ids between the marks of a text, one more than there are marks."""
        made = (self.bare if bare else self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0]
        ids = np.array(made.ids, self.dtype)
        size, blob = ids.itemsize, ids.tobytes()
        cuts = [-1, *np.flatnonzero(ids == self.mark[0]).tolist(), len(ids)]
        return [blob[(a + 1) * size : b * size] for a, b in pairwise(cuts)]

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of pieces. Words of letters are one unit to the splitting rule and take a shorter way,
        with a mark after them too, which is a unit of its own."""
        young = self.memo.young
        known: dict[str, bytes] = {}
        groups: dict[tuple[bool, bool], list[str]] = {(line, easy): [] for line in (False, True) for easy in (False, True)}
        marked, others = [], []
        stems = set()
        for p in pieces:
            stem = p
            if p and p[-1] in _MARKS and (c := p[-2:-1]).isalnum() and c < "\u0250" and c != "\u0130":
                stem = p[:-1]
                marked.append(p)
                if stem in young or stem in stems:
                    continue
                stems.add(stem)
            elif p in stems:
                continue
            line = stem.startswith("\n")
            word = stem[1:] if line else stem
            easy = word.isascii()
            if word.isalpha() if easy else _LATIN.fullmatch(word):
                stems.add(stem)
                groups[line, easy].append(stem)
            elif stem is p:
                others.append(p)
            else:
                marked.pop()
                stems.discard(stem)
                others.append(p)
        for (line, _), some in groups.items():
            lead, space = (self.mark.tobytes(), "") if line else (b"", "\u0120" if self.rule == "spaced" else "")
            for i in range(0, len(some), GROUP):
                group = some[i : i + GROUP]
                known.update(zip(group, [lead + f for f in self._units(group, space)] if line else self._units(group, space), strict=True))
        for p in marked:
            ids = known.get(p[:-1]) or young[p[:-1]]
            known[p] = ids + self.marks[p[-1]]
        if others:
            known.update(self._learn_spaced(others) if self.rule == "spaced" else self._learn_dropped(others))
        return known

    def _units(self, words: list[str], space: str) -> list[bytes]:
        """The ids of words of letters, after a space or a line feed, without a pass of the splitting
        rule. Where a word ends follows from the lengths of the tokens."""
        text = " ".join(words).replace("\n", "")
        if self.rule == "dropped":
            text = text.lower()
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(self.visible)
        text = space + text.replace(" ", " " + space)
        ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
        ends = np.cumsum(np.fromiter(map(len, text.split(" ")), np.int64, len(words)))
        reach = np.cumsum(self.lengths[ids])
        at = np.searchsorted(reach, ends)
        if at[-1] >= len(reach) or (reach[at] != ends).any():
            return self._between_marks(text.replace(" ", f" {self.line} "), bare=True)
        size, blob = self.dtype.itemsize, ids.tobytes()
        cuts = ((at + 1) * size).tolist()
        return [blob[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    def _learn_spaced(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of words after a space, or with the line feed before them; none for words with
        white space at an end."""
        known: dict[str, bytes] = {}
        for line in (False, True):
            some = [p for p in pieces if p.startswith("\n") is line]
            bare = [p[1:] for p in some] if line else some
            if " ".join(bare).split() != bare:
                some = [p for p, w in zip(some, bare, strict=True) if w and not w[0].isspace() and not w[-1].isspace()]
                bare = [p[1:] for p in some] if line else some
            if some and line:
                found, mark = self._between_marks("".join(some))[1:], self.mark.tobytes()
                known.update(zip(some, (mark + f for f in found), strict=True))
            elif some:
                known.update(zip(some, self._between_marks(" " + "\n ".join(bare)), strict=True))
        return known

    def _learn_dropped(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of words; a word that has the mark itself is encoded alone."""
        some = [p for p in pieces if "~" not in p]
        known = dict(zip(some, self._between_marks(" ~ ".join(some)), strict=True)) if some else {}
        known.update((p, self.whole(p).tobytes()) for p in pieces if "~" in p)
        return known

    def _careful(self, text: str, first: bool) -> bytes:
        """A text with runs of white space: cut only at single spaces inside it."""
        words = [w if first and not i else " " + w for i, w in enumerate(_INSIDE.split(text))]
        inner = [w[1:] for w in words[1:-1] if "\n" not in w]
        known = dict(zip(inner, self.memo.look([[w] for w in inner]), strict=True))
        return b"".join(known.get(w[1:]) or self.whole(w).tobytes() if 0 < i < len(words) - 1 else self.whole(w).tobytes() for i, w in enumerate(words))

    def _spaced(self, texts: list[tuple[str, bool]]) -> list[bytes]:
        plain = ["\n\n" not in t and "  " not in t for t, _ in texts]
        lists = [(("\n" + t).replace("\n", " \n")[1:] if first else t.replace("\n", " \n")).split(" ") if ok else [] for (t, first), ok in zip(texts, plain, strict=True)]
        own = self.mark.nbytes
        return [self._careful(t, first) if not ok or f is None else f[own:] if first else f for (t, first), ok, f in zip(texts, plain, self.memo.look(lists), strict=True)]

    def _joined(self, texts: list[tuple[str, bool]]) -> list[bytes]:
        if self.rule == "spaced":
            return self._spaced(texts)
        return self.memo.look([t.replace("\n", " ").split(" ") for t, _ in texts])

    def _has_added(self, text: str) -> bool:
        """Whether the text may hold a token that is found before any splitting."""
        return self.added is not None and self.lead in text and self.added.search(text) is not None

    def _by_library(self, text: str) -> np.ndarray:
        """The ids of a text, by the library alone; no added token holds a space."""
        if self.rule is None or " " in self.added.pattern:
            return self.whole(text)
        lead = " " if self.rule == "spaced" else ""
        return np.concatenate([self.whole(lead * (i > 0) + s) for i, s in enumerate(_segments(text, self._between()))])

    def _between(self) -> re.Pattern:
        return _INSIDE if self.rule == "spaced" else re.compile(" ")

    def _long(self, text: str) -> np.ndarray:
        between = self._between()
        return np.frombuffer(b"".join(self._joined([(s, not i)])[0] for i, s in enumerate(_segments(text, between))), self.dtype)

    def many(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; unknown words of up to CHUNK characters of texts are encoded together."""
        out: list[np.ndarray] = [np.empty(0, self.dtype)] * len(texts)
        held: list[int] = []
        size = 0

        def flush() -> None:
            for i, found in zip(held, self._joined([(texts[i], True) for i in held]), strict=True):
                out[i] = np.frombuffer(found, self.dtype)
            held.clear()

        for i, text in enumerate(texts):
            if not text:
                continue
            if self.rule is None:
                out[i] = self.whole(text)
            elif self._has_added(text):
                out[i] = self._by_library(text)
            elif len(text) > CHUNK:
                out[i] = self._long(text)
            else:
                if size + len(text) > CHUNK:
                    flush()
                    size = 0
                held.append(i)
                size += len(text)
        flush()
        return out

    def ids(self, text: str | None) -> np.ndarray:
        return self.many([text])[0]


def read_file(path: str) -> bytes:
    """The tokenizer file, on the driver; tasks get its content."""
    with open(path, "rb") as f:
        return f.read()


def held(key: tuple, make: Callable[[], T]) -> T:
    """What make() gave for the key, kept by this process. One thing is held; another's takes its place."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def shared(file: bytes, plain: bool = False) -> Encoder:
    """This process's encoder of the file."""
    return held((file, plain), lambda: Encoder(file, plain=plain))


def release() -> bool:
    """Let go of the encoder that is held; whether there was one."""
    had = bool(_held)
    _held.clear()
    if had:
        gc.collect()  # it refers to itself
    return had
