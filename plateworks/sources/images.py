"""Width and height of an image from the first bytes of its file."""

from __future__ import annotations

# Signatures of image files, and the JPEG markers that a frame's size follows or that have no length.
PNG, BMP, RIFF, WEBP, JPEG = b"\x89PNG\r\n\x1a\n", b"BM", b"RIFF", b"WEBP", b"\xff\xd8"
FRAMES, BARE = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}, {0x01, *range(0xD0, 0xD9)}


def size_of(data: bytes) -> tuple[int, int] | None:
    """(width, height) of a PNG, BMP, WebP or JPEG file; None for anything else, or if it is cut off."""
    big = lambda at, n: int.from_bytes(data[at : at + n], "big")
    little = lambda at, n: int.from_bytes(data[at : at + n], "little")
    if data.startswith(PNG) and len(data) >= 24:
        return big(16, 4), big(20, 4)
    if data.startswith(BMP) and len(data) >= 26:
        return little(18, 4), abs(int.from_bytes(data[22:26], "little", signed=True))
    if data.startswith(RIFF) and data[8:12] == WEBP and len(data) >= 30:
        kind = data[12:16]
        if kind == b"VP8X":
            return little(24, 3) + 1, little(27, 3) + 1
        if kind == b"VP8L":
            bits = little(21, 4)
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        return little(26, 2) & 0x3FFF, little(28, 2) & 0x3FFF
    if data.startswith(JPEG):
        at = 2
        while at + 9 <= len(data) and data[at] == 0xFF:
            marker = data[at + 1]
            if marker in FRAMES:
                return big(at + 7, 2), big(at + 5, 2)
            at += 1 if marker == 0xFF else 2 if marker in BARE else 2 + big(at + 2, 2)
    return None
