"""Access to public vocabularies inside tasks.

Files are found by name through public_tokenizers on whatever machine runs the task and are loaded once per
Python worker; none is shipped, copied or trained.
"""

from __future__ import annotations

import base64
import json
import os
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
import tiktoken
from tokenizers import Tokenizer

BYTE_BPE = "byte_bpe_50k"
END_OF_TEXT = "<|endoftext|>"
END_OF_TEXT_ID = 50256
#: Runs beyond this go to tokenizers one by one: tiktoken's pattern gives up on a million white-space characters, and
#: its merging takes quadratic time on words of such lengths. What a run says does not depend on what lies around it.
LONG_RUN = 4096
_LONG_SPACE = regex.compile(rf"\p{{White_Space}}{{{LONG_RUN},}}+")
_LONG_WORD = regex.compile(rf"[^\p{{White_Space}}]{{{LONG_RUN},}}+")


@lru_cache(maxsize=4)
def tokenizer(name: str = BYTE_BPE, added: tuple[str, ...] = ()) -> Tokenizer:
    """The tokenizers form, without truncation or padding; added strings become special tokens after the vocabulary."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; Spark runs them side by side
    found = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    found.no_truncation()
    found.no_padding()
    if added:
        found.add_special_tokens(list(added))
    return found


@lru_cache(maxsize=4)
def ranks(name: str = BYTE_BPE) -> dict[bytes, int]:
    """Bytes of each ordinary piece with its id."""
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def special_ids(name: str = BYTE_BPE, added: tuple[str, ...] = ()) -> dict[str, int]:
    """The end-of-text string and the added strings, which follow the vocabulary's last id."""
    return {END_OF_TEXT: END_OF_TEXT_ID} | {x: tokenizer(name, added).token_to_id(x) for x in added}


@lru_cache(maxsize=4)
def fast_encoding(name: str = BYTE_BPE, added: tuple[str, ...] = ()) -> tiktoken.Encoding:
    """The same vocabulary in tiktoken, which gives the same ids several times faster (tests compare the two)."""
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(name), special_tokens=special_ids(name, added))


@lru_cache(maxsize=4)
def _special_pattern(added: tuple[str, ...]) -> re.Pattern:
    return re.compile("(" + "|".join(map(re.escape, (END_OF_TEXT, *added))) + ")")


def encode_text(text: str, name: str = BYTE_BPE, added: tuple[str, ...] = ()) -> list[int]:
    """Ids of a whole text as tokenizers gives them with add_special_tokens=False; added strings are special tokens."""
    if len(text) < LONG_RUN:
        return _fast(text, name, added)
    ids: list[int] = []
    for part in _special_pattern(added).split(text):  # words end where a special token stands
        at = 0
        for start, end in _slow_spans(part):
            ids += _fast(part[at:start], name, added)
            ids += tokenizer(name, added).encode(part[start:end], add_special_tokens=False).ids
            at = end
        ids += _fast(part[at:], name, added)
    return ids


@lru_cache(maxsize=4)
def piece_lengths(name: str = BYTE_BPE, added: tuple[str, ...] = ()) -> np.ndarray:
    """Bytes of each id's piece."""
    of = {i: len(piece) for piece, i in ranks(name).items()} | {i: len(x.encode()) for x, i in special_ids(name, added).items()}
    out = np.zeros(max(of) + 1, np.int64)
    out[list(of)] = list(of.values())
    return out


def encode_with_offsets(text: str, name: str = BYTE_BPE, added: tuple[str, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and start and end of each token in code points.

    Pieces' bytes follow each other without a gap, so their lengths say where each lies; a token that holds part of
    a character's bytes has that character's span.
    """
    ids = np.array(encode_text(text, name, added), np.int64)
    raw = np.frombuffer(text.encode(), np.uint8)
    character = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
    ends = np.cumsum(piece_lengths(name, added)[ids])
    starts = np.concatenate(([0], ends[:-1])) if len(ids) else ends
    return ids, np.column_stack((character[starts], character[ends - 1] + 1))


def _slow_spans(text: str) -> list[tuple[int, int]]:
    """Spans that hold long runs and begin and end where words do, in order.

    A white-space run is one word but for its last character, which stands alone or with the word after it, if there
    is one. A run without white space goes with the one white-space character before it.
    """
    if len(text) < LONG_RUN:
        return []
    spans = [(found.start(), found.end() - (found.end() < len(text))) for found in _LONG_SPACE.finditer(text)]
    spans += [(max(0, found.start() - 1), found.end()) for found in _LONG_WORD.finditer(text)]
    return sorted(spans)


def _fast(text: str, name: str, added: tuple[str, ...]) -> list[int]:
    return fast_encoding(name, added).encode(text, allowed_special="all", disallowed_special=()) if text else []


#: Stands for the end of a word in tiktoken's bytes; texts that hold it go to tokenizers.
WORD_END = "\0"
#: Runs of ASCII and the Latin letters below need no normalizing but lower case, which is the same everywhere for them.
_PLAIN = "!-~À-ÖØ-öø-ÿŒœ"
_PLAIN_RUN = re.compile(f"[{_PLAIN}]*")
_PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿœ]+|[0-9]|[^ a-zß-öø-ÿœ0-9]+")  # the tokenizer file's pattern, for these characters
_SPECIAL = "<|"


@lru_cache(maxsize=2)
def word_encoding(name: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """A vocabulary with word ends in tiktoken, and whether each id ends a word.

    A word's last byte and the end that follows it are merged before all else, as their ranks are the lowest, so words
    begin as they do in the tokenizers form; from there both merge in the same order (tests compare the two).
    """
    with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as lines:
        model = json.load(lines)["model"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level vocabularies show as themselves
    of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    end = model["end_of_word_suffix"]
    raw = {piece: bytes(of[c] for c in piece.removesuffix(end)) + (WORD_END.encode() if piece.endswith(end) else b"") for piece in model["vocab"]}
    ends = np.zeros(max(model["vocab"].values()) + 1, bool)
    ends[[i for piece, i in model["vocab"].items() if piece.endswith(end)]] = True
    return tiktoken.Encoding(name, pat_str=rf"[^{WORD_END} ]+{WORD_END}", mergeable_ranks={raw[piece]: i for piece, i in model["vocab"].items()}, special_tokens={}), ends


def encode_runs(runs: list[str], name: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of each run's) of runs without white space, for a vocabulary with word ends, as tokenizers gives them with add_special_tokens=False."""
    plain = np.fromiter((bool(_PLAIN_RUN.fullmatch(x)) and _SPECIAL not in x and len(x) < LONG_RUN for x in runs), bool, len(runs))
    encoding, ends = word_encoding(name)
    marked = _PLAIN_WORDS.sub(rf"\g<0>{WORD_END}", " ".join([x for x, p in zip(runs, plain.tolist()) if p]).lower())
    fast = np.array(encoding.encode_ordinary(marked), np.int32)
    words = np.fromiter((x.count(WORD_END) for x in marked.split(" ")), np.int64) if plain.any() else np.zeros(0, np.int64)
    word_ends = np.concatenate(([0], np.flatnonzero(ends[fast]) + 1))  # each word ends in one token that says so
    upto = word_ends[np.cumsum(words)]
    counts = np.zeros(len(runs), np.int64)
    counts[plain] = np.diff(upto, prepend=0)
    if plain.all():
        return fast, counts
    slow = [e.ids for e in tokenizer(name).encode_batch_fast([x for x, p in zip(runs, plain.tolist()) if not p], add_special_tokens=False)]
    counts[~plain] = list(map(len, slow))
    ids = np.zeros(counts.sum(), np.int32)
    is_fast = np.repeat(plain, counts)
    ids[is_fast] = fast
    ids[~is_fast] = np.fromiter((i for x in slow for i in x), np.int32)
    return ids, counts
