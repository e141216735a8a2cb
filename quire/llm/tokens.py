"""Token ids of whole texts, as Arrow batches inside Spark tasks."""

from __future__ import annotations

MAX_CACHED_WORDS = 400_000
MAX_CACHED_PIECES = 600_000
GROUP_CHARS = 2_000_000


class WordEncoder:
    """Encodes texts with the ``tokenizers`` library, each distinct word once.

    Where the tokenizer drops white space and splits words into runs of letters, single digits and
    runs of other characters, the ids of a text are those of its words one after another. Words are
    then encoded once and kept (both tables are emptied when they reach their bound), which avoids
    the library's slow splitter on repeated words. A text of common characters alone is lower-cased
    and cut into the tokenizer's pieces at once, so its words need no table of their own. Any other
    tokenizer encodes whole texts.
    """

    def __init__(self, path: str, literal_specials: bool = False):
        import json
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.np = np
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal_specials
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        splits = [p.get("pattern", {}).get("Regex") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        norms = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.by_word = (splits[:1] == [r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"]
                        and norms == ["NFC", "Replace", "Lowercase"]
                        and spec["model"].get("end_of_word_suffix") == "</w>")
        # pieces of ASCII or of lower-cased common characters need no normalising and no splitting
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(
            add_prefix_space=False, use_regex=False)])
        vocab = spec["model"]["vocab"]
        self.ends = np.zeros(max(vocab.values()) + 8, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        # characters that are their own NFC and whose lower case is one character, white space and letters
        # told apart as the tokenizer does: Latin letters without U+0130 and U+0149, common punctuation
        self.uncommon = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\u012f\u0131-\u0148\u014a-\u017f\u2010-\u2027\u20ac]").search
        self.cut = re.compile(r"[a-zªµºÀ-ÖØ-öø-ſ]+|[0-9²³¹¼½¾]|'(?:s|t|re|ve|m|ll|d)|[^\sa-zªµºÀ-ÖØ-öø-ſ0-9²³¹¼½¾]+").findall
        # white space, control characters, apostrophes, special tokens and the letter whose lower case ends
        # in a mark take the whole-word way
        self.odd = re.compile(r"[\x00-\x20\x7f'\u0130]|<\|")
        self.runs = re.compile(r"[a-z]+|[0-9]|[^a-z0-9]+").findall
        self.core = re.compile(r"([\x21-\x26\x28-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]*)(.+?)"
                               r"([\x21-\x26\x28-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]*)").fullmatch
        # a comma or full stop between a letter or digit and white space is a piece of its own
        self.stops = re.compile(r"(?<=[A-Za-z0-9])([,.])(?=[ \n])").sub
        self.other_stop = re.compile(r"[^A-Za-z0-9][,.][ \n]").search
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [self.np.array(e.ids, dtype="<u4").tobytes()
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _split(self, word: str) -> list[str] | None:
        """The tokenizer's pieces of a word, or None where only the library may split it."""
        if self.odd.search(word):
            return None
        if word.isascii():
            return self.runs(word.lower())
        m = self.core(word)
        if m and m[2].isalpha():
            return [p for p in m.groups() if p]
        return None

    def _words(self, text: str) -> list[str]:
        """The text cut at spaces and line ends, and before the stops that are pieces of their own."""
        if self.other_stop(text) or text[:1] in (",", "."):
            return self.stops(r" \1", text).replace("\n", " ").split(" ")
        # all stops before white space are of that kind: plain replacements do, and are faster
        return text.replace("\n", " ").replace(", ", " , ").replace(". ", " . ").split(" ")

    def _learn_pieces(self, new: list[str]) -> None:
        self._encode_pieces(self.plain, [p for p in new if p.isascii()])
        self._encode_pieces(self.tokenizer, [p for p in new if not p.isascii()])

    def _encode_pieces(self, tokenizer, new: list[str]) -> None:
        np = self.np
        for i in range(0, len(new), 2000):
            part = new[i:i + 2000]
            ids = np.array(tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part) and stops[-1] == len(ids):
                raw, cuts = ids.tobytes(), (4 * stops).tolist()
                self.pieces.update(zip(part, [raw[a:b] for a, b in zip([0, *cuts], cuts)]))
            else:  # a letter that lower-cases into several pieces: one by one
                self.pieces.update(zip(part, self._whole(part)))

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        """Ids of words met for the first time; they are kept for later texts."""
        if len(self.words) + len(new) > MAX_CACHED_WORDS:
            self.words.clear()
        if len(self.pieces) > MAX_CACHED_PIECES:
            self.pieces.clear()
        words, known = {}, self.pieces
        single, several, whole = [], [], []
        for w in new:
            if w.isalpha():
                p = w.lower() if w.isascii() else w
                ids = known.get(p)
                if ids is None:
                    single.append((w, p))
                else:
                    words[w] = ids
            elif (split := self._split(w)) is None:
                whole.append(w)
            else:
                several.append((w, split))
        unknown = dict.fromkeys(p for _, p in single)
        unknown.update(dict.fromkeys(p for _, split in several for p in split))
        self._learn_pieces([p for p in unknown if p not in known])
        for w, p in single:
            words[w] = known[p]
        for w, split in several:
            words[w] = b"".join(map(known.__getitem__, split))
        words.update(zip(whole, self._whole(whole)))
        self.words.update(words)
        return words

    def _learn_common(self, new: set[str]) -> dict[str, bytes]:
        """Ids of pieces of common characters met for the first time, among those that are kept."""
        if len(self.pieces) > MAX_CACHED_PIECES:
            self.pieces.clear()
        self._encode_pieces(self.plain, [p for p in new if p not in self.pieces])
        return self.pieces

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every text; none for null."""
        if not self.by_word:
            return self._whole([t or "" for t in texts])
        out: list[bytes] = []
        # in groups, so that new words of many texts are encoded together; what is known is looked up text by
        # text, so that only the new words of a group are held
        group: list[list[bytes | None]] = []
        gaps: tuple[list, list] = ([], [])
        chars = 0

        def flush():
            for new, learn in zip(gaps, (self._learn, self._learn_common)):
                learned = learn({p for _, _, ps in new for p in ps})
                for found, at, ps in new:
                    for i, p in zip(at, ps):
                        found[i] = learned[p]
                new.clear()
            out.extend(map(b"".join, group))
            group.clear()

        for t in texts:
            t = t or ""
            common = "<|" not in t and not self.uncommon(t)
            parts = self.cut(t.lower()) if common else self._words(t)
            found = list(map((self.pieces if common else self.words).get, parts))
            if None in found:
                at = [i for i, ids in enumerate(found) if ids is None]
                gaps[common].append((found, at, [parts[i] for i in at]))
            group.append(found)
            chars += len(t)
            if chars > GROUP_CHARS:
                flush()
                chars = 0
        flush()
        return out


def encoder(path: str, literal_specials: bool = False) -> WordEncoder:
    """The worker process's encoder of a tokenizer file, kept between the tasks it runs. It is kept
    on ``sys``, since the module itself travels by value and is made anew for every task."""
    import sys

    kept = vars(sys).setdefault("_quire_encoders", {})
    if (path, literal_specials) not in kept:
        kept[path, literal_specials] = WordEncoder(path, literal_specials)
    return kept[path, literal_specials]


def text_batches(batches, size: int = 16_000_000):
    """Slices of Arrow batches whose texts have about ``size`` bytes at most, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    for b in batches:
        if b.num_rows == 0:
            continue
        lens = np.asarray(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        group = (np.cumsum(lens) - lens) // size
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), b.num_rows]
        for a, z in zip(cuts, cuts[1:]):
            yield b.slice(a, z - a)
