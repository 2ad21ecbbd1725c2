"""The v9 rules case by case, and batches against the state packet by packet."""

import random
import struct
from datetime import datetime, timedelta, timezone

import pytest

from weirflow.sources import netflow9 as n9

KEYS = "collector_id string, source_host string, source_ip string, source_id long, packet binary, received_at timestamp, arrival long"
START = datetime(2026, 6, 28, 1)


def u(number, width):
    return number.to_bytes(width, "big")


def packet(count, uptime, seconds, sequence, source, *sets):
    body = b"".join(struct.pack(">HH", k, len(b) + 4) + b for k, b in sets)
    return struct.pack(">HHIIII", 9, count, uptime, seconds, sequence, source) + body


def padded(body):
    return body + b"\0" * (-len(body) % 4)


def record(tid, fields):
    return struct.pack(">HH", tid, len(fields)) + b"".join(struct.pack(">HH", *f) for f in fields)


def option(tid, scopes, options):
    return struct.pack(">HHH", tid, 4 * len(scopes), 4 * len(options)) + b"".join(struct.pack(">HH", *f) for f in [*scopes, *options])


def template(*templates):
    return 0, padded(b"".join(record(*t) for t in templates))


def options(*templates):
    return 1, padded(b"".join(option(*t) for t in templates))


def fold(state, at, *args):
    return list(state.fold(packet(*args), float(at)))


def errors(found):
    return [f.error for f in found if f.error]


def test_typed_fields_and_padding():
    fields = [(8, 4), (27, 16), (1, 8), (82, 8), (400, 3), (400, 2)]
    data = bytes([192, 0, 2, 10]) + bytes.fromhex("20010db8000000000000000000000010") + b"\xff" * 8 + b"eth0\0\0\0\0" + b"\1\2\3" + b"\4\5"
    got = fold(n9.Exporter(), 0, 2, 1000, 100, 10, 7, template((256, fields)), (256, data + b"\xa5" * 3))
    assert [f.fields for f in got] == [{8: "192.0.2.10", 27: "2001:db8::10", 1: str(2**64 - 1), 82: "eth0", 400: "010203"}]


def test_options_and_sampling():
    state = n9.Exporter()
    data = u(9, 4) + u(100, 4) + u(1, 1) + b"eth9\0\0\0\0"
    got = fold(state, 0, 2, 1000, 100, 10, 7, options((300, [(2, 4)], [(34, 4), (35, 1), (82, 8)])), (300, data + b"\0\0\0"))
    assert [(f.scopes, f.fields) for f in got] == [({2: "9"}, {34: "100", 35: "1", 82: "eth9"})]
    assert state.sampling == {"interface": 9, "interval": 100, "algorithm": 1} and state.names == {9: "eth9"}
    fold(state, 1, 2, 1001, 101, 11, 7, options((301, [(5, 2)], [(50, 4)])), (301, u(3, 2) + u(7, 4)))
    assert state.sampling["interval"] == 100 and state.sampling["sampler"] == 3  # a random interval displaces no other


def test_several_templates_in_one_flowset():
    state = n9.Exporter()
    got = fold(state, 0, 4, 100, 100, 1, 7, template((256, [(8, 4)]), (257, [(1, 8)])), options((300, [(2, 4)], [(34, 4)]), (301, [(5, 2)], [(35, 1)])))
    assert got == [] and sorted(state.known) == [(0, 256), (0, 257), (1, 300), (1, 301)]


def test_kinds_are_apart():
    state = n9.Exporter()
    fold(state, 0, 1, 1, 1, 1, 7, template((256, [(1, 4)])))
    fold(state, 1, 1, 2, 2, 2, 7, options((256, [(2, 4)], [(34, 4)])))
    got = fold(state, 2, 1, 3, 3, 3, 7, (256, u(5, 4)))
    assert [(f.scopes, f.fields) for f in got] == [(None, {1: "5"})]


def test_expiry_replay_and_redefinition():
    state = n9.Exporter()
    fold(state, 0, 1, 100, 100, 1, 7, template((256, [(1, 4)])))
    assert [f.fields for f in fold(state, 1800, 1, 101, 101, 2, 7, (256, u(7, 4)))] == [{1: "7"}]
    assert fold(state, 3600, 1, 102, 102, 3, 7, (256, u(7, 4))) == [] and len(state.waiting) == 1  # use doesn't renew a template
    got = fold(state, 3601, 1, 103, 103, 4, 7, template((256, [(1, 8)])))
    assert errors(got) == ["template_redefined"] and not state.waiting
    state = n9.Exporter()
    fold(state, 0, 1, 100, 100, 1, 7, template((256, [(1, 4)])))
    fold(state, 3600, 1, 102, 102, 3, 7, (256, u(7, 4)))
    assert fold(state, 3601, 1, 103, 103, 4, 7, options((256, [(2, 2)], [(34, 2)]))) == []  # another kind isn't what it waits for
    assert [f.fields for f in fold(state, 3602, 1, 104, 104, 5, 7, template((256, [(1, 4)])))] == [{1: "7"}]


def test_refresh_redefinition_and_silence():
    state = n9.Exporter()
    fold(state, 0, 1, 100, 100, 1, 7, template((256, [(1, 4)])))
    fold(state, 1800, 1, 101, 101, 2, 7, template((256, [(1, 4)])))
    assert len(fold(state, 4000, 1, 102, 102, 3, 7, (256, u(5, 4)))) == 1
    fold(state, 4001, 1, 103, 103, 4, 7, template((256, [(1, 8)])))
    assert state.known[0, 256][2] == 2
    fold(state, 4002, 1, 104, 104, 5, 7, (999, b"abcd"))
    assert errors(fold(state, 4001 + n9.IDLE_S + 1, 0, 105, 105, 6, 7)) == ["pending_expired"] and not state.known and not state.expired


def test_replay_in_order_of_receipt():
    state = n9.Exporter()
    for i, v in enumerate((10, 20)):
        assert fold(state, i, 1, 100 + i, 100, i, 7, (256, u(v, 4))) == []
    assert [f.fields[1] for f in fold(state, 2, 1, 102, 102, 2, 7, template((256, [(1, 4)])))] == ["10", "20"]


def test_timeout_and_eviction(monkeypatch):
    monkeypatch.setattr(n9, "PENDING_BYTES", 8)
    state = n9.Exporter()
    fold(state, 0, 1, 1, 1, 1, 7, (256, b"abcdef"))
    assert errors(fold(state, 0.1, 1, 2, 2, 2, 7, (257, b"ghijkl"))) == ["pending_evicted"]
    assert [f.error for f in state.expire(31)] == ["pending_expired"] and state.facts["bytes"] == 0 and state.deadline() is None
    assert errors(fold(state, 32, 1, 3, 3, 3, 7, (257, b"x" * 9))) == ["pending_limit"]


def test_restart_and_wraparound():
    state = n9.Exporter()
    fold(state, 0, 1, 1000, 100, 100, 7, template((256, [(1, 4)])))
    fold(state, 1, 1, 1001, 100, 101, 7, (300, b"abcd"))
    assert errors(fold(state, 2, 0, 10, 101, 1, 7)) == ["exporter_restart"] and not state.known
    assert fold(state, 3, 1, 11, 102, 2, 7, (256, u(1, 4))) == []  # the old template is forgotten
    state = n9.Exporter()
    fold(state, 0, 1, 2**32 - 5, 100, 2**32 - 1, 7, template((256, [(1, 4)])))
    fold(state, 1, 0, 3, 101, 0, 7)
    assert state.known
    fold(state, 2, 0, 1, 1, 2**32 - 1, 7)  # the export time goes back too
    assert state.known


@pytest.mark.parametrize(("data", "code"), [
    (b"\0\t", "malformed_packet"), (struct.pack(">HHIIII", 10, 0, 0, 0, 0, 0), "unsupported_version"), (packet(0, 1, 1, 1, 1, (2, b"")), "invalid_flowset_id"),
    (packet(0, 1, 1, 1, 1) + b"\0\0\0\x14", "invalid_flowset_boundary"), (packet(0, 1, 1, 1, 1) + b"\0", "invalid_flowset_boundary"),
    (packet(2, 1, 1, 1, 1, template((256, [(1, 4)]))), "invalid_record_count"), (packet(1, 1, 1, 1, 1, template((256, [(1, 0)]))), "invalid_field_length"),
    (packet(1, 1, 1, 1, 1, template((255, [(1, 4)]))), "invalid_template"), (packet(1, 1, 1, 1, 1, (0, struct.pack(">HH", 256, 129))), "template_limit"),
    (packet(1, 1, 1, 1, 1, (1, struct.pack(">HHHH", 300, 5, 4, 0))), "invalid_options_template"), (packet(1, 1, 1, 1, 1, options((300, [], [(34, 4)]))), "invalid_options_template"),
    (packet(1, 1, 1, 1, 1, template((256, [(1, 65000), (2, 1000)]))), "record_limit"), (packet(2, 1, 1, 1, 1, template((256, [(1, 8)])), (256, b"abcd")), "invalid_flowset_length"),
    (packet(2, 1, 1, 1, 1, template((256, [(8, 3)])), (256, b"abcd")), "invalid_field_length"), (packet(2, 1, 1, 1, 1, template((256, [(82, 4)])), (256, b"ab\xffd")), "invalid_string"),
    (packet(1, 1, 1, 1, 1, (256, b"abcd"), template((257, [(1, 4)]))), "invalid_record_count"),
])
def test_refused_as_a_whole(spark, data, code):
    sound = (256, [(1, 4)])
    assert [(f.error, f.fields) for f in n9.Exporter().fold(data, 0.0)] == [(code, None)]
    both = packet(3, 1, 1, 1, 1, template(sound), (256, u(1, 4)), (256, b"ab"))
    assert [(f.error, f.fields) for f in n9.Exporter().fold(both, 0.0)] == [("invalid_flowset_length", None)]
    got = n9.parse(spark.createDataFrame([("c", "h", "i", 7, bytearray(data), START, 1)], KEYS)).collect()
    assert [(r.error, r.fields) for r in got] == [(code, None)]


def history(seed, sources=3, packets=250):
    """Packets of some exporters that restart, fall silent, redefine, expire and mix kinds."""
    rng, rows = random.Random(seed), []
    for source in range(sources):
        at, uptime, seconds, sequence = rng.random() * 100, 1000, 1000, 2**32 - 20 if source else 50
        for _ in range(packets):
            at += rng.choice([0.0, 1.0, 1.0, 5.0, 20.0, 40.0, 600.0, 1900.0] if rng.random() < 0.97 else [90000.0])
            uptime, seconds, sequence = (uptime + 10) % 2**32, seconds + 1, (sequence + 1) % 2**32
            if rng.random() < 0.03:
                uptime, sequence = 5, rng.choice([0, 3])
            sets, count = [], 0
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                tid, kind = rng.choice([256, 257, 258]), rng.random()
                if kind < 0.2:
                    sets.append(template((tid, rng.choice([[(1, 4)], [(2, 4)], [(1, 2), (2, 2)]]))))
                elif kind < 0.3:
                    sets.append(options((tid, [(2, 2)], [rng.choice([(34, 2), (35, 2), (50, 2)])])))
                else:
                    sets.append((tid, bytes(rng.randrange(1, 250) for _ in range(4 * rng.choice([1, 1, 2])))))
                count += 1 if sets[-1][0] < 256 else len(sets[-1][1]) // 4
            waits = count if rng.random() < 0.98 else count + 1
            rows.append(("c", "h", f"10.0.0.{source}", 7, bytearray(packet(waits, uptime, seconds, sequence, 7, *sets)), START + timedelta(seconds=at), len(rows)))
    return rows


def key_of(r):
    return (r.source_ip, r.packet_sequence, r.record_index, r.template_id, r.error, tuple(sorted((r.fields or {}).items())), r.flowset_index)


@pytest.mark.parametrize("seed", range(4))
def test_batch_equals_the_state_packet_by_packet(spark, seed):
    rows = history(seed)
    want = []
    for source in sorted({r[2] for r in rows}):
        own = sorted((r for r in rows if r[2] == source), key=lambda r: (r[5], r[6]))
        state = n9.Exporter()
        for r in own:
            want += [(source, f) for f in state.fold(bytes(r[4]), r[5].replace(tzinfo=timezone.utc).timestamp())]
        end = max(r[5] for r in own).replace(tzinfo=timezone.utc).timestamp()
        want += [(source, f) for f in state.expire(end)]
    wanted = sorted(((s, f.head and f.head.sequence, f.index, f.template_id, f.error, tuple(sorted((f.fields or {}).items())), f.flowset) for s, f in want if f.scopes is None), key=repr)
    random.Random(seed).shuffle(rows)
    got = sorted((key_of(r) for r in n9.parse(spark.createDataFrame(rows, KEYS).repartition(5)).collect()), key=repr)
    kinds = {w[4] for w in wanted}
    assert {"exporter_restart", "pending_expired", None} <= kinds
    assert [g for g in got if g not in wanted] == [] and got == wanted


def test_sampling_of_a_batch(spark):
    at = lambda s: START + timedelta(seconds=s)
    row = lambda s, n, p: ("c", "h", "i", 7, bytearray(p), at(s), n)
    rows = [
        row(0, 0, packet(2, 900, 1, 900, 7, options((300, [(2, 4)], [(34, 4), (82, 4)])), (300, u(4, 4) + u(10, 4) + b"old\0"))),
        row(1, 1, packet(0, 10, 2, 1, 7)),  # a restart
        row(2, 2, packet(3, 20, 3, 2, 7, options((300, [(2, 4)], [(34, 4), (82, 4)])), (300, u(4, 4) + u(20, 4) + b"eth4" + u(5, 4) + u(30, 4) + b"eth5"))),
        row(3, 3, packet(2, 30, 4, 3, 7, options((301, [(5, 2)], [(49, 1), (50, 4)])), (301, u(6, 2) + u(2, 1) + u(99, 4)))),
    ]
    got = n9.sampling(spark.createDataFrame(rows, KEYS)).collect()
    assert [(r.interval, r.algorithm, r.sampler, r.interfaces) for r in got] == [(30, 2, 6, {4: "eth4", 5: "eth5"})]


def test_sampling_of_the_last_epoch_alone(spark):
    """An epoch that ends at the very time at which its last words came says nothing any more."""
    said = packet(3, 5000, 1000, 50, 7, options((300, [(2, 4)], [(34, 4)])), (300, u(1, 4) + u(77, 4) + u(2, 4) + u(78, 4)))
    anew = packet(2, 10, 1001, 1, 7, options((300, [(2, 4)], [(35, 1)])), (300, u(1, 4) + u(2, 1)))
    rows = [("c", "h", "1", 7, p, START, i) for i, p in enumerate([said, anew])]
    (got,) = n9.sampling(spark.createDataFrame(rows, KEYS)).collect()
    assert (got["interval"], got["algorithm"]) == (None, 2)
