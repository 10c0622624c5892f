"""Encoding with a public byte-level BPE vocabulary.

The vocabulary file's path is a parameter. The driver reads it and sends its bytes,
under a megabyte, with the task, so executors need no copy.

Ids are those of the vocabulary's own encoding at any length. The library's pattern
matcher fails on very long runs of white space, so each long run is handed over as
the one piece that the pattern makes of it: all of the run but its last character,
which may begin the next piece, or all of it at the end of the text.
"""

from __future__ import annotations

import base64
import re

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's split pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The free id after the vocabulary's last: ends each document, and pads rows.
END = 50256
#: White space as that pattern has it, and runs that are handed over by themselves.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LONG_RUN = 4096
_RUNS = re.compile(f"[{SPACE}]{{{LONG_RUN},}}(?=[^{SPACE}]|(\\Z))")


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def model(vocabulary: bytes):
    """The library's encoding. A worker builds it once and keeps it between tasks."""
    import tiktoken

    kept = vars(tiktoken).setdefault("_bramble_encoders", {})
    key = hash(vocabulary)
    if key not in kept:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        kept[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return kept[key]


def encoder(vocabulary: bytes):
    """text -> list of ids."""
    made = model(vocabulary)
    plain, piece = made.encode_ordinary, made._encode_single_piece

    def encode(text: str) -> list[int]:
        if len(text) < LONG_RUN:
            return plain(text)
        out: list[int] = []
        at = 0
        for run in _RUNS.finditer(text):
            end = run.end() if run.group(1) is not None else run.end() - 1
            out += plain(text[at : run.start()])
            out += piece(text[run.start() : end])
            at = end
        return out + plain(text[at:])

    return encode
