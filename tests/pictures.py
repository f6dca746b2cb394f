"""PNG files with the standard library only."""

import struct
import zlib


def png(path, pixels):
    """Write an array [h, w], [h, w, 3] or [h, w, 4] of bytes."""
    height, width = pixels.shape[:2]
    kind = {2: 0, 3: 2, 4: 6}[pixels.ndim if pixels.ndim == 2 else pixels.shape[2]]

    def chunk(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    rows = b"".join(b"\0" + pixels[y].tobytes() for y in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(
        b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    )
