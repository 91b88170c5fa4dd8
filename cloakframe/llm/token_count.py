"""Token counts: pre-tokens that are one whole token are counted directly, the rest is merged.

Which vocabulary strings encode alone as one token is proved offline, once, on the
driver, and sent to the tasks.

Defined results: null text counts as empty (0 bytes, 0 tokens); rows repeat as
given; null ids stay null; an empty table gives no rows; extra columns of the input are
ignored; very long texts are counted whole, a very long pre-token by the library's merges.
"""

from __future__ import annotations

import json

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, map_texts

# The byte-level pre-token pattern and its byte alphabet rule.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
# Scripts for which the pattern above and the library's own splitter were compared
# code point by code point; other texts are split by the library.
COMPARED = r"[^\x00-\x1B\x20-\x7E\xA0-˿‐-‧‰-⁞€]"


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    out, spare = {b: chr(b) for b in PRINTABLE}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(spare)
            spare += 1
    return out


def whole_tokens(path: str) -> dict[str, int]:
    """The vocabulary strings, as the pre-tokenizer writes them, that are proved to encode as one token alone.

    The merges run over every entry once, on the driver; tasks get the result. Added
    tokens that do more than stand for themselves are refused.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") and spec.get("normalizer") for t in spec["added_tokens"]):
        raise ValueError("an added token of this vocabulary also takes what is beside it")
    merges, special, alphabet = Tokenizer.from_file(path).model, {t["content"] for t in spec["added_tokens"]}, set(byte_alphabet().values())
    return {p: 1 for p in spec["model"]["vocab"] if p not in special and alphabet.issuperset(p) and len(merges.tokenize(p)) == 1}


class WholeTokenCounter:
    """Counts the tokens of texts as the tokenizers library does without added tokens.

    `whole` holds the strings proved to encode as exactly one token (see whole_tokens);
    these are looked up in every script, and only other pre-tokens are merged.
    """

    def __init__(self, path: str, whole: dict[str, int] | None = None) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.tokenizer, self.alphabet = Tokenizer.from_file(path), byte_alphabet()
        self.whole = whole_tokens(path) if whole is None else whole
        back = {c: b for b, c in self.alphabet.items()}
        # the same strings as they stand in texts; a string that is no whole character stands in none
        said = (bytes(map(back.__getitem__, p)).decode("utf-8", "replace") for p in self.whole)
        self.plain_whole = {p: 1 for p in said if "\ufffd" not in p}
        self.merges = Remembered(32 << 20)
        self.split_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.pre, self.unusual = regex.compile(PRE_TOKEN), regex.compile(COMPARED)

    def merged(self, token: str, mapped: str | None = None) -> int:
        """The count of a pre-token that is no whole token, by running its merges; `mapped` is it in the byte alphabet."""
        known = self.merges.get(token)
        if known is None:
            mapped = mapped or "".join(map(self.alphabet.__getitem__, token.encode("utf-8")))
            known = self.merges.keep(token, len(self.tokenizer.model.tokenize(mapped)), 2 * len(token))
        return known

    def plain(self, text: str) -> int:
        if self.unusual.search(text):
            whole = self.whole.get
            return sum(whole(x) or self.merged(x, x) for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text))
        whole, merged = self.plain_whole.get, self.merged
        return sum([whole(t) or merged(t) for t in self.pre.findall(text)])

    def count(self, text: str) -> int:
        """Special strings inside the text are one token each, as by default in the library."""
        if self.split_special is None or not any(s in text for s in self.special):
            return self.plain(text)
        return sum(map(self.plain, self.split_special.split(text))) + len(self.split_special.findall(text))


def count_tokens(df: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit for every row; a map over the scan, nothing is shuffled."""
    # at most the vocabulary's size: bounded by the tokenizer, not by the data
    whole = df.sparkSession.sparkContext.broadcast(whole_tokens(tokenizer_path))

    def make():
        counter = WholeTokenCounter(tokenizer_path, whole.value)
        return lambda text: (len(text.encode("utf-8")), counter.count(text))

    out = map_texts(df, id_col, text_col, make, "n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
