"""What the first bytes of an image file tell: size, colour mode, date and place. A small helper for tasks; nothing is decoded."""

from __future__ import annotations

import struct

Header = tuple[int | None, int | None, str | None, str | None, bool]
NOTHING: Header = (None, None, None, None, False)

JPEG, PNG, GIF = b"\xff\xd8\xff", b"\x89PN", b"GIF"
#: Tags of dates, of the place's directory, and of latitude and longitude in it.
TAKEN, CHANGED, PLACE, LATITUDE, LONGITUDE, DETAILS = 36867, 306, 34853, 2, 4, 34665


def is_image_content(head: bytes | None, content_type: str | None = None) -> bool:
    """Whether what an address returned is an image: by its declared type, or its first bytes."""
    return (content_type or "").lower().startswith("image/") or (head or b"")[:3] in (JPEG, PNG)


def image_header(head: bytes) -> Header:
    """Width, height, mode, date taken and whether a place is given; nulls for what is no JPEG, PNG or GIF, or broken."""
    try:
        if head[:3] == PNG and head[12:16] == b"IHDR":
            width, height, depth, colour = struct.unpack(">IIBB", head[16:26])
            return width, height, {0: "1" if depth == 1 else "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}.get(colour), None, False
        if head[:3] == GIF:
            return *struct.unpack("<HH", head[6:10]), "P", None, False
        if head[:3] == JPEG:
            return _jpeg(head)
    except (struct.error, IndexError):
        pass
    return NOTHING


def _jpeg(head: bytes) -> Header:
    at, taken, located = 2, None, False
    while at + 4 <= len(head):
        if head[at] != 0xFF:
            return NOTHING
        mark, size = head[at + 1], struct.unpack(">H", head[at + 2 : at + 4])[0]
        body = head[at + 4 : at + 2 + size]
        if mark == 0xE1 and body[:6] == b"Exif\0\0":
            taken, located = _exif(body[6:])
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            height, width, parts = struct.unpack(">HHB", body[1:6])
            return width, height, {1: "L", 3: "RGB", 4: "CMYK"}.get(parts), taken, located
        at += 2 + size
    return NOTHING


def _exif(data: bytes) -> tuple[str | None, bool]:
    order = "<" if data[:2] == b"II" else ">"

    def entries(at: int) -> dict[int, tuple[int, int, int]]:
        if not 0 < at < len(data) - 2:
            return {}
        n = struct.unpack(order + "H", data[at : at + 2])[0]
        rows = (data[at + 2 + 12 * i : at + 14 + 12 * i] for i in range(n))
        return {tag: (kind, count, value) for r in rows if len(r) == 12 for tag, kind, count, value in [struct.unpack(order + "HHII", r)]}

    def text(entry: tuple[int, int, int] | None) -> str | None:
        if entry is None or entry[0] != 2:
            return None
        return data[entry[2] : entry[2] + entry[1]].split(b"\0")[0].decode("latin-1").strip() or None

    top = entries(struct.unpack(order + "I", data[4:8])[0])
    details = entries(top[DETAILS][2]) if DETAILS in top else {}
    place = entries(top[PLACE][2]) if PLACE in top else {}
    return text(details.get(TAKEN)) or text(top.get(TAKEN)) or text(top.get(CHANGED)), LATITUDE in place and LONGITUDE in place
