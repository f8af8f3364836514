"""Token ids of whole texts by a public tokenizer file, with a memory for words.

For a tokenizer that turns white space into single blanks and drops them, ignores
the case of A-Z, and parts letters from the marks and digits beside them, a text's
ids are those of its words in turn. Whether a file describes such a tokenizer is read
from its own normaliser and splitting rule; for any other file texts are encoded
whole by the library.
"""

from __future__ import annotations

import json
from array import array

from loomlog.llm.common import hand_back

#: Words whose ids a task remembers.
REMEMBERED = 250_000
#: Marks that may end a word; an apostrophe can begin a part of its own.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: The last of the Latin letters that are taken as they stand.
LATIN = "\u017f"
#: The parts of a tokenizer file whose words stand for themselves.
NORMALIZERS = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    {"type": "Lowercase"},
]
SPLIT = {
    "type": "Split",
    "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
    "behavior": "Removed",
    "invert": True,
}


def words_stand_alone(definition: str) -> bool:
    """Whether the file's ids of a text are those of its words, one after another."""
    file = json.loads(definition)
    normalizer, splitter, model = (file.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
    steps = splitter.get("pretokenizers") or [{}]
    return (
        normalizer.get("normalizers") == NORMALIZERS
        and steps[0] == SPLIT
        and [s.get("type") for s in steps[1:]] == ["ByteLevel"]
        and not steps[1].get("add_prefix_space", True)
        and not steps[1].get("use_regex", True)
        and model.get("type") == "BPE"
        and not model.get("dropout")
        and not any(" " in t["content"] or "\n" in t["content"] or t["lstrip"] or t["rstrip"] for t in file["added_tokens"])
    )


class Letters(dict):
    """Of each letter the letters that stand for its bytes."""

    def __init__(self, spell):
        super().__init__()
        self.spell = spell

    def __missing__(self, code: int) -> str:
        self[code] = spelt = self.spell(chr(code))[0][0]
        return spelt


class Words(dict):
    """Ids of words as little-endian 32-bit numbers, found when first asked for."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.normal = tokenizer.normalizer.normalize_str
        self.letters = Letters(tokenizer.pre_tokenizer[1].pre_tokenize_str)

    def __missing__(self, word: str) -> bytes:
        stem = word.rstrip(MARKS)
        plain = None
        if stem.isalpha():
            # Latin letters but one have one small letter each, and no other form.
            latin = stem.isascii() or (max(stem) <= LATIN and "\u0130" not in stem)
            plain = stem.lower() if latin else self.normal(stem)
        if not plain or not plain.isalpha():  # or a letter that becomes letter and mark
            ids = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        elif plain != word:
            ids = self[plain] + self[word[len(stem) :]] if len(stem) < len(word) else self[plain]
        else:
            letters = plain if plain.isascii() else plain.translate(self.letters)
            ids = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
        self[word] = ids
        return ids


class WordTokenizer:
    """Ids of texts as little-endian 32-bit numbers."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.known = Words(self.tokenizer) if words_stand_alone(definition) else None
        hand_back()  # the file as read, several times the tokenizer

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.known is None:
            found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
            return [array("I", e.ids).tobytes() for e in found]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        ids = self.known.__getitem__
        return [b"".join(map(ids, t.replace("\n", " ").split(" "))) for t in texts]
