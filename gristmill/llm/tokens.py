"""Token ids by public vocabularies."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache

import numpy as np


@lru_cache(maxsize=4)
def encoder(vocabulary: str, special: bool = True) -> Callable[[str], np.ndarray]:
    """Text to uint32 ids of a byte-level BPE vocabulary file (JSON), without special tokens added.

    special: their strings in a text become their ids, as the file's own library has it;
    otherwise they are ordinary text.

    The merges are run by the faster of the two installed libraries, built from the
    same file, if the file says nothing that it would do otherwise; texts that it
    refuses, and other files, go to the other.
    """
    import tiktoken

    with open(vocabulary, encoding="utf-8") as f:
        held = json.load(f)
    if not plain(held):
        return lambda text: np.array(library(vocabulary, special).encode(text, add_special_tokens=False).ids, np.uint32)
    added = {x["content"]: x["id"] for x in held["added_tokens"]}
    byte = {c: b for b, c in enumerate(letters())}
    ranks = {bytes(byte[c] for c in piece): n for piece, n in held["model"]["vocab"].items() if piece not in added}
    fast = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=added)
    allowed = set(added) if special else set()

    def encode(text: str) -> np.ndarray:
        try:
            return np.asarray(fast.encode_to_numpy(text, allowed_special=allowed, disallowed_special=()), np.uint32)
        except (KeyboardInterrupt, SystemExit):
            raise
        except BaseException:  # noqa: BLE001  a panic of the library's regex engine on extreme texts is no Exception
            return np.array(library(vocabulary, special).encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def plain(held: dict) -> bool:
    """Is it byte-level BPE by the published pattern, whose merges come in the order of the ids that they make?"""
    model, cut = held["model"], held.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or held.get("normalizer") or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")):
        return False
    if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        return False
    if any(x.get(k) for x in held["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        return False
    vocab = model["vocab"]
    made = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    single = [vocab.get(c, -1) for c in letters()]
    return min(single) >= 0 and all(a < b for a, b in zip([max(single), *made], made)) and len(vocab) <= len(made) + 256 + sum(x["content"] in vocab for x in held["added_tokens"])


@lru_cache(maxsize=4)
def highest_id(vocabulary: str) -> int:
    """The largest id of a vocabulary file."""
    with open(vocabulary, encoding="utf-8") as f:
        held = json.load(f)
    return max([*held["model"]["vocab"].values(), *(x["id"] for x in held["added_tokens"])])


@lru_cache(maxsize=4)
def library(vocabulary: str, special: bool = True):
    """The file's own library, loaded when a text needs it."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(vocabulary)
    found.encode_special_tokens = not special
    return found


#: Fixed value: the published split pattern of byte-level BPE.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def letters() -> list[str]:
    """The printable letter that byte-level BPE files write for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]
