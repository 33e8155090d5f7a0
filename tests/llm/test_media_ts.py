import hashlib
import os
import zlib

import pytest

from quarry.llm import media_ts as M


@pytest.mark.parametrize("n", [64, 128, 192, 16384, 16448, 150016])
def test_round_trip(n):
    payload = os.urandom(n)
    s = M.demux(M.mux(payload))
    assert s.payload == payload and s.pts == [k * M.TICKS for k in range(-(-n // M.UNIT))]
    assert s.access_points == list(range(0, len(s.pts), M.GOP)) and s.program == 1 and s.es_pid == 0x100


def test_all_payload_lengths():
    for n in range(1, 800):
        assert M.demux(M.mux(b"x" * n)).payload == b"x" * n


@pytest.mark.parametrize("at,what", [(0, "sync"), (188 * 3 + 3, "continuity|payload|stream|damaged"), (8, "damaged"), (188 + 20, "damaged")])
def test_damage_is_found(at, what):
    data = bytearray(M.mux(b"abc" * 400))
    data[at] ^= 0x05
    with pytest.raises(ValueError, match=what):
        M.demux(bytes(data))
    with pytest.raises(ValueError, match="whole"):
        M.demux(bytes(data[:-1]))


def test_lost_packet_is_found():
    data = M.mux(b"abc" * 4000)
    with pytest.raises(ValueError, match="continuity"):
        M.demux(data[: 188 * 5] + data[188 * 6 :])


def test_columns(spark):
    rows = [(1, "é" * 50), (2, None), (3, ""), (2, "x" * 64), (None, "y")]
    df = spark.createDataFrame([(i, t, b"") for i, t in rows], "doc_id long, text string, media binary")
    got = {(r.doc_id, r.n_bytes): r for r in M.from_media(M.to_media(df), keep_payload=True).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        r = got[i, len(raw)]
        want = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert bytes(r.payload) == want and r.payload_sha256 == hashlib.sha256(want).hexdigest() and r.tail_crc32 == zlib.crc32(want[-64:])
    assert M.to_media(df.limit(0)).count() == 0


class Foreign:
    """Transport streams written packet by packet, in ways that ``mux`` never does."""

    def __init__(self):
        self.out, self.counter = [], {}

    def packet(self, pid, payload=b"", start=False, field=None, count=True):
        """One packet; ``field`` are an adaptation field's flags and the rest of it."""
        room = 184 - len(payload)
        control, head = 1, b""
        if field is not None or room:
            head = b"" if field is None else field
            stuffing = room - 1 - len(head)
            if not payload:
                control = 2
            else:
                control = 3
            assert stuffing >= 0
            head = bytes([room - 1]) + ((head or b"\x00")[: room - 1] + b"\xff" * (room - 1 - len(head or b"\x00")) if room > 1 else b"")
        n = self.counter.get(pid, 15)
        if control & 1 and count:
            n = self.counter[pid] = (n + 1) % 16
        self.out.append(bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255, control << 4 | n]) + head + payload)
        assert len(self.out[-1]) == 188

    def table(self, pid, section):
        raw = b"\x00" + section
        for k in range(0, len(raw), 184):
            self.packet(pid, raw[k : k + 184].ljust(184, b"\xff"), start=k == 0)

    def tables(self, descriptors=b"", stream=0x1B):
        self.table(0, M._section(0, 7, b"\x00\x00\xe0\x10" + b"\x00\x05\xe0\x42"))
        self.packet(0x42, b"")
        body = b"\xe0\x51" + (0xF000 | len(descriptors)).to_bytes(2, "big") + descriptors + bytes([stream, 0xE0, 0x51, 0xF0, 0]) + b"\x0f\xe0\x52\xf0\x00"
        self.table(0x42, M._section(2, 5, body))

    def data(self):
        return b"".join(self.out)


def test_foreign_stream():
    """A network table, a map table over three packets, unbounded video packets, others between, repetitions and gaps that are told."""
    f = Foreign()
    f.tables(descriptors=b"\x05\x04HDMV" * 80)
    units, want = [os.urandom(k) for k in (10, 500, 1000, 184 * 3)], []
    for k, unit in enumerate(units):
        pts = (1 << 33) - 100 + k if k < 2 else k
        flags = b"\x80\x80\x05" + M._pts_bytes(pts) if k != 3 else b"\x80\x00\x02\xff\xff"
        raw = b"\x00\x00\x01\xe0\x00\x00" + flags + unit
        want.append(pts if k != 3 else None)
        clock = b"\x50" + M._pcr_bytes(9000 + k) if k != 1 else None
        first = raw[: 150]
        f.packet(0x51, first, start=True, field=clock)
        if k == 0:
            f.out.append(f.out[-1])  # a legal repetition
        f.packet(0x52, b"\x00\x00\x01\xc0\x00\x00\x80\x00\x00sound", start=True)
        for a in range(150, len(raw), 184):
            if k == 2 and a == 150 + 184:
                f.counter[0x51] = 3
                f.packet(0x51, b"", field=b"\x80")  # no payload, but says that the counter jumps
            f.packet(0x51, raw[a : a + 184])
        f.packet(0x1FFF, b"")
    s = M.demux(f.data())
    assert s.payload == b"".join(units) and s.pts == want and s.access_points == [0, 2, 3]
    assert s.program == 5 and s.es_pid == 0x51 and s.pcr == [9000, 9000, 9002, 9003]


def test_faults_of_foreign_streams():
    def stream(change):
        f = Foreign()
        f.tables()
        for k in range(3):
            f.packet(0x51, b"\x00\x00\x01\xe0\x00\x00\x80\x80\x05" + M._pts_bytes(k) + bytes([k] * 170), start=True)
        change(f)
        return f.data()

    assert M.demux(stream(lambda f: None)).pts == [0, 1, 2]
    faults = {"continuity": lambda f: f.out.pop(-2), "no table": lambda f: f.out.pop(0), "damaged": lambda f: f.out.append(f.out.pop().replace(b"\x00\x00\x01\xe0", b"\x00\x00\x02\xe0"))}
    for name, change in faults.items():
        with pytest.raises(ValueError, match=name):
            M.demux(stream(change))
    with pytest.raises(ValueError, match="continuity"):  # a second repetition
        M.demux(stream(lambda f: f.out.extend([f.out[-1]] * 2)))


def test_pcr_of_own_streams():
    s = M.demux(M.mux(b"x" * (M.UNIT * 3)))
    assert s.pcr == [0, M.TICKS, 2 * M.TICKS]


def test_damaged_rows_have_an_error(spark):
    good = M.mux(b"abc" * 400)
    bad = bytearray(good)
    bad[0] = 0
    rows = [(1, 5, good, "x"), (2, 5, bytes(bad), "x"), (3, 5, b"", "x"), (4, 5, None, "x"), (5, 5, os.urandom(188 * 4), "x"), (None, None, good[:376], "x")]
    df = spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary, error string")
    got = {r.doc_id: r for r in M.from_media(df).collect()}
    assert len(got) == 6 and got[1].error is None and got[1].payload_bytes == 1200
    assert all(got[k].error and got[k].payload_bytes is None and got[k].pts is None for k in (2, 3, 4, 5, None))


def test_any_bytes_give_a_stream_or_a_fault():
    import random

    rng = random.Random(4)
    for _ in range(400):
        data = bytearray(M.mux(b"abcd" * rng.randrange(1, 300)))
        for _ in range(rng.randrange(1, 6)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        try:
            M.demux(bytes(data))
        except ValueError:
            pass


def test_long_texts_and_clashing_names(spark):
    text = "é long text " * 200_000
    df = spark.createDataFrame([(1, text, "x", 2)], "doc_id long, text string, pts string, payload int")
    r = M.from_media(M.to_media(df)).first()
    raw = M.payload_of(text)
    assert r.payload_sha256 == hashlib.sha256(raw).hexdigest() and len(r.pts) == -(-len(raw) // M.UNIT) and r.error is None
