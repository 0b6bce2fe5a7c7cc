"""Tokenizer files inside tasks."""

from __future__ import annotations

import json
import os
import re

#: Texts of these characters alone, without the start of a special token, are cut
#: alike by every version of the Unicode tables, so both libraries give the same ids.
PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-ÿ]*")


#: A run of this many characters of one kind goes to ``tokenizers``: ``tiktoken`` overflows its stack on very long ones.
#: Shorter texts are not searched.
LONG_RUN = 10_000
RUN = re.compile(rf"\s{{{LONG_RUN}}}|\S{{{LONG_RUN}}}")


def path_of(tokenizer: str) -> str:
    """A file path as it is; a bare name is a file of the public tokenizer package."""
    if os.sep in tokenizer:
        return tokenizer
    import public_tokenizers
    return public_tokenizers.path(tokenizer)


def load(tokenizer: str):
    """The ``tokenizers`` tokenizer of a JSON file, without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path_of(tokenizer))
    t.no_truncation()
    t.no_padding()
    return t


class Encoder:
    """Ids of whole texts, as the ``tokenizers`` library gives them for ``tokenizer``.

    ``ranks`` optionally names the same byte-level vocabulary as merge ranks:
    ``PLAIN`` texts without very long runs then go through ``tiktoken``, four times as
    fast (equality is tested); every other text goes through ``tokenizers``.
    """

    def __init__(self, tokenizer: str, ranks: str | None = None):
        self.slow, self.fast = load(tokenizer), None
        if ranks is not None:
            import base64

            import public_tokenizers
            import tiktoken
            with open(path_of(ranks), "rb") as lines:
                merge = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merge,
                                          special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if (self.fast is not None and "<|" not in text and PLAIN.fullmatch(text)
                and (len(text) < LONG_RUN or not RUN.search(text))):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


class Counter:
    """Numbers of tokens that a lower-casing BPE tokenizer with word ends gives for whole texts.

    Such a tokenizer cuts a text into words by a pattern, and each word by itself.  For
    ``PLAIN`` texts without the start of a special token, ``WORDS`` cuts the lower-cased text
    in the same places (tested), so the counts of words met before are looked up, and only
    new words are encoded; at most ``REMEMBERED`` of up to ``LONG_WORD`` characters are kept.
    Other texts are encoded whole, and so are all texts of other tokenizers."""

    #: The tokenizer's own pattern, over ``PLAIN`` in lower case.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")
    REMEMBERED, LONG_WORD = 200_000, 64

    def __init__(self, tokenizer: str):
        self.whole, self.known = load(tokenizer), {}
        with open(path_of(tokenizer)) as f:
            parts = json.load(f)
        steps = [s["type"] for s in (parts["normalizer"] or {}).get("normalizers", [])]
        cut = ((parts["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        self.by_word = (steps == ["NFC", "Replace", "Lowercase"] and not parts["post_processor"]
                        and cut.get("pattern", {}).get("Regex") == self.PATTERN and cut.get("behavior") == "Removed")

    def count(self, word: str) -> int:
        n = self.known.get(word)
        if n is None:
            n = len(self.whole.encode(word, add_special_tokens=False).ids)
            if len(word) <= self.LONG_WORD:
                if len(self.known) >= self.REMEMBERED:
                    self.known.clear()
                self.known[word] = n
        return n

    def __call__(self, text: str) -> int:
        if not self.by_word or "<|" in text or not PLAIN.fullmatch(text):
            return len(self.whole.encode(text, add_special_tokens=False).ids)
        low, total, at = text.lower(), 0, 0
        while at < len(low):
            # a piece ends at a blank, where no word goes on
            end = at + PIECE
            while end < len(low) and not low[end].isspace():
                end += 1
            words = self.WORDS.findall(low, at, min(end, len(low)))
            try:
                total += sum(map(self.known.__getitem__, words))
            except KeyError:
                total += sum(map(self.count, words))
            at = end
        return total


#: Characters of a long text that are cut into words at a time.
PIECE = 1 << 18
