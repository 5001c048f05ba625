"""Addresses of both families against the standard library."""

import ipaddress
import random

from pyspark.sql import functions as F

from riskflow.functions.addresses import address_hex
from riskflow.functions.urls import is_public_address
from riskflow.operators.address_ranges import with_block

ODD = [
    "::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::2::3", "1:2:3", ":1:2", "1:::2", "12345::", "g::1",
    "::ffff:8.8.8.8", "::ffff:10.0.0.1", "64:ff9b::8.8.8.8", "1.2.3.4::", "::1.2.3.256", "1:2:3:4:5:6:7:1.2.3.4", "1:2:3:4:5:6:1.2.3.4",
    "fe80::1%eth0", "FE80::ABCD", "fec0::1", "2001:4:112::1", "2001:1::1", "2001:1::3", "3fff:fff::1", "5f00::1", "ff02::1", "100::1",
    "192.0.0.9", "192.0.0.8", "192.88.99.1", "01.2.3.4", "1.2.3", "1.2.3.4.5", "", " ", "host.example.com", "255.255.255.255", "0.0.0.0",
]


def parsed(text):
    try:
        return ipaddress.ip_address(text)
    except (ValueError, TypeError):
        return None


def samples():
    rng = random.Random(5)
    out = [*ODD, None]
    for _ in range(400):
        out.append(str(ipaddress.IPv4Address(rng.getrandbits(32))))
        top = rng.choice([rng.getrandbits(16), 0x2001, 0x2001, 0x2002, 0x3FFF, 0xFE80, 0x2A00, 0xFC00])
        mid = rng.choice([rng.getrandbits(16), rng.getrandbits(8), 0x0DB8, 0])
        v6 = ipaddress.IPv6Address(top << 112 | mid << 96 | rng.choice([0, rng.getrandbits(96)]))
        out.append(rng.choice([str(v6), v6.exploded, str(v6).upper()]))
    return out


def test_numbers_and_public(spark):
    df = spark.createDataFrame([(s,) for s in samples()], "address string")
    rows = df.select("address", address_hex(F.col("address")).alias("n"), is_public_address(F.col("address")).alias("p")).collect()
    for r in rows:
        ip = parsed(r.address)
        assert r.n == (None if ip is None else f"{int(ip):0{ip.max_prefixlen // 4}x}"), r
        closed = ip is None or any(
            getattr(ip, a) for a in ("is_loopback", "is_private", "is_link_local", "is_multicast", "is_unspecified", "is_reserved")
        ) or not ip.is_global or ip in ipaddress.ip_network("3fff::/20")  # not in every edition of the library
        assert r.p == (not closed), r


def test_longest_block(spark):
    rng = random.Random(6)
    texts = samples()
    blocks = ["0.0.0.0/0", "::/0", "bad/8", "1.2.3.4/33", None, "10.0.0.0", "10.9.9.9/8", "10.0.0.0/8", "2001:db8::/32", "2001:d00::/24"]
    for text in rng.sample([t for t in texts if parsed(t) and "%" not in t], 120):
        blocks.append(f"{text}/{rng.randint(1, parsed(text).max_prefixlen // 3)}")
    nets = {}
    for i, text in enumerate(blocks):
        try:
            net = ipaddress.ip_network(text, strict=False) if text else None
        except ValueError:
            net = None
        if net is not None:
            nets[net] = min(nets.get(net, (text, i)), (text, i))
    # a third of all rows has one address; a column of the table has the same name
    data = [(i, t, "kept") for i, t in enumerate(texts + ["10.1.1.1"] * 400)]
    ranges = spark.createDataFrame([(t, i) for i, t in enumerate(blocks)], "cidr string, owner int")
    out = with_block(spark.createDataFrame(data, "id int, address string, cidr string"), "address", ranges).collect()
    assert len(out) == len(data) and all(r.cidr == "kept" for r in out)
    for r in out:
        ip = parsed(r.address)
        held = [n for n in nets if ip is not None and ip.version == n.version and int(ip) >> (n.max_prefixlen - n.prefixlen) == int(n.network_address) >> (n.max_prefixlen - n.prefixlen)]
        want = nets[max(held, key=lambda n: n.prefixlen)] if held else None
        assert (None if r.block is None else (r.block.cidr, r.block.info.owner)) == want, r
    assert with_block(spark.createDataFrame([], "address string"), "address", ranges).count() == 0
    assert with_block(spark.createDataFrame([("1.1.1.1",)], "address string"), "address", ranges.limit(0)).head().block is None
