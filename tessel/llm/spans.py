"""Character spans of patterns in texts: what the secret and personal-data scans share."""

from __future__ import annotations

import hashlib

#: (kind, start, end), code points, end exclusive.
Span = tuple[str, int, int]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()


def overlaps(start: int, end: int, spans: list[Span]) -> bool:
    return any(start < e and s < end for _, s, e in spans)


def replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each (start, end, replacement) put in; of overlapping spans the earliest, longest one counts."""
    out, at = [], 0
    for start, end, new in sorted(spans, key=lambda x: (x[0], -x[1])):
        if start >= at:
            out += [text[at:start], new]
            at = end
    return "".join([*out, text[at:]])
