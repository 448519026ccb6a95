"""Token ids of whole texts by the tokenizers library, asking it for each distinct word once.

The library's normaliser and pre-tokenizer never look across ASCII white space where the file says so (``separable``), so a text's ids are its
words' ids one after another. Words of ASCII and of plain Latin letters are cut into pre-tokens here, each of which the library's model
encodes once; any other word is encoded whole by the library. Words and pre-tokens that are known stay Arrow arrays, so nothing in Python
touches a word that has come up before.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

#: Words remembered from one batch of texts to the next, by a task and by those after it in its Python process; only speed depends on it.
KEEP_WORDS = 800_000
#: Pre-tokens that the library gets at once.
_AT_ONCE = 2_000
_LATIN = "a-zß-öø-ÿ"
_SIMPLE = "^[!-~À-ÖØ-öø-ÿ]+$"
_PIECE = rf"('s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^0-9{_LATIN}]+)"
#: The settings of a tokenizer file under which words can be told apart as above.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def separable(settings: dict) -> bool:
    """Whether a tokenizer file lower-cases, drops white space and splits by the pattern above, with bytes as alphabet."""
    split, *rest = (settings.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    return (
        settings.get("normalizer") == _NORMALIZER
        and (split.get("pattern"), split.get("behavior"), split.get("invert")) == ({"Regex": _SPLIT}, "Removed", True)
        and [(p.get("type"), p.get("add_prefix_space"), p.get("use_regex")) for p in rest] == [("ByteLevel", False, False)]
    )


def _letters() -> dict[int, str]:
    """The byte-level alphabet for the bytes of simple words: printable Latin-1 stands for itself, the others follow from U+0100 on; spaces stay."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)} | {0x20: " "}


class _Known:
    """Ids of strings: ``ids[ends[i]:ends[i + 1]]`` are those of ``strings[i]``."""

    def __init__(self):
        self.strings = pa.array([], pa.binary())
        self.ids, self.ends = np.empty(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def __len__(self) -> int:
        return len(self.strings)

    def find(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of each of these different strings, and the places of those that are new; they get the next numbers, in order."""
        at = pc.index_in(strings, value_set=self.strings)
        new = np.flatnonzero(at.is_null())
        out = np.asarray(at.fill_null(0)).astype(np.int64)
        out[new] = len(self) + np.arange(len(new))
        return out, new

    def add(self, strings: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.strings = pa.concat_arrays([self.strings, strings])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])

    def spell(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the strings of these numbers one after another, and where each string's begin (and the last one's end)."""
        begin = self.ends.take(numbers)
        upto = np.zeros(len(numbers) + 1, dtype=np.int64)
        np.cumsum(self.ends.take(numbers + 1) - begin, out=upto[1:])
        place = np.repeat(begin - upto[:-1], np.diff(upto))
        place += np.arange(len(place))
        return self.ids.take(place), upto


def _numbered(strings: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """For each string the number of its value, and the different values."""
    found = strings.dictionary_encode()
    return np.asarray(found.indices).astype(np.int64), found.dictionary


class WordIds:
    """Encodes texts with the tokenizer of a file's content; strings of its special tokens are ordinary text."""

    def __init__(self, content: bytes):
        self.tokenizer = Tokenizer.from_str(content.decode())
        self.tokenizer.encode_special_tokens = True
        settings = json.loads(content)
        self.cut = separable(settings)
        self.alphabet = _letters()
        # the model alone, on pre-tokens between spaces; where a last id shows that a pre-token ends, many go at once
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        suffix = settings["model"].get("end_of_word_suffix")
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(names.values(), default=0) + 1, dtype=bool)
        self.last[[i for name, i in names.items() if suffix and name.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.words, self.pieces = _Known(), _Known()

    def _by_library(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)]
        return np.array([i for ids in lists for i in ids], dtype=np.int32), np.array([len(ids) for ids in lists], dtype=np.int64)

    def _by_model(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens, and the number of each."""
        parts = [pieces[i : i + _AT_ONCE] for i in range(0, len(pieces), _AT_ONCE)]
        letters = [b" ".join(p).decode("latin-1").translate(self.alphabet) for p in parts]
        found = [np.array(e.ids, dtype=np.int32) for e in self.model.encode_batch_fast(letters, add_special_tokens=False)]
        ends = [np.flatnonzero(self.last[f]) + 1 for f in found]
        if all(len(e) == len(p) and len(f) == e[-1] for e, f, p in zip(ends, found, parts, strict=True)):
            sizes = [np.diff(e, prepend=0) for e in ends]
        else:
            lists = [[t.id for t in self.tokenizer.model.tokenize(w)] for part in letters for w in part.split(" ")]
            found, sizes = [np.array([i for ids in lists for i in ids], dtype=np.int32)], [np.array([len(ids) for ids in lists], dtype=np.int64)]
        return np.concatenate([np.empty(0, dtype=np.int32), *found]), np.concatenate([np.empty(0, dtype=np.int64), *sizes])

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Adds different words that aren't known; the number that each gets."""
        simple = pc.match_substring_regex(words.view(pa.string()), _SIMPLE)
        ours, others = words.filter(simple), words.filter(pc.invert(simple))
        # a line feed behind each pre-token, so a word's last part is empty, and so are its ids
        cut = pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(ours.view(pa.string())), _PIECE, r"\1" "\n"), "\n")
        parts, values = _numbered(cut.flatten().view(pa.binary()))
        numbers, new = self.pieces.find(values)
        fresh = values.take(pa.array(new))
        size = np.asarray(pc.binary_length(fresh))
        ids, sizes = self._by_model([p for p in fresh.to_pylist() if p])
        every = np.zeros(len(new), dtype=np.int64)
        every[size > 0] = sizes
        self.pieces.add(fresh, ids, every)
        ids, upto = self.pieces.spell(numbers[parts])
        first = len(self.words)
        self.words.add(ours, ids, np.diff(upto[np.asarray(cut.offsets).astype(np.int64)]))
        self.words.add(others, *self._by_library([w.decode("utf-8", "replace") for w in others.to_pylist()]))
        # those of ours come first, then the others
        place = np.empty(len(words), dtype=np.int64)
        place[np.argsort(~np.asarray(simple), kind="stable")] = first + np.arange(len(words))
        return place

    def encode(self, texts: pa.Array | Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and the number of each; a null text has none."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary())
        if texts.null_count:
            texts = texts.fill_null(b"")
        if not self.cut:
            return self._by_library([t.decode("utf-8", "replace") for t in texts.to_pylist()])
        if len(self.words) > KEEP_WORDS:
            self._forget()
        # only ASCII white space is looked for, so the texts needn't be valid UTF-8
        lists = pc.ascii_split_whitespace(texts.view(pa.large_string() if pa.types.is_large_binary(texts.type) else pa.string()))
        at, words = _numbered(lists.flatten().view(pa.binary()))
        numbers, new = self.words.find(words)
        if len(new):
            numbers[new] = self._learn(words.take(pa.array(new)))
        ids, upto = self.words.spell(numbers[at])
        bound = np.asarray(lists.offsets).astype(np.int64)
        return ids, np.diff(upto[bound - bound[0]])


@lru_cache(maxsize=1)
def kept(content: bytes) -> WordIds:
    """The process's ``WordIds`` for a tokenizer file's content, with the words of earlier tasks."""
    return WordIds(content)
