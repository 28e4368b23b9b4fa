"""Keys of usual sizes, in the places where they occur."""

import base64
import struct

import pytest

from tessera.llm import secrets


def der(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else b"\x81" + bytes([n]) if n < 256 else b"\x82" + n.to_bytes(2, "big")) + body


def wire(*fields):
    return b"".join(struct.pack(">I", len(f)) + f for f in fields)


CURVE = bytes.fromhex("06082a8648ce3d030107")
POINT = der(0x03, b"\0\x04" + bytes(range(100, 164)))
EC_PRIVATE = der(0x30, der(0x02, b"\x01") + der(0x04, bytes(range(32))) + der(0xA0, CURVE) + der(0xA1, POINT))
EC_PUBLIC = der(0x30, der(0x30, bytes.fromhex("06072a8648ce3d0201") + CURVE) + POINT)
ED25519 = der(0x30, der(0x02, b"\0") + der(0x30, bytes.fromhex("06032b6570")) + der(0x04, der(0x04, bytes(range(32)))))
RSA = der(0x30, b"".join(der(0x02, bytes([1]) + bytes(range(60))) for _ in range(9)))
SSH = wire(b"ssh-ed25519", bytes(range(32)))
SSH_RSA = wire(b"ssh-rsa", b"\1\0\1", b"\0" + bytes(range(7, 256)))
OPENSSH = b"openssh-key-v1\0" + wire(b"none", b"none", b"") + b"\0\0\0\1" + wire(SSH, bytes(range(136)))
VALUES = {"ec_private": (EC_PRIVATE, "key"), "ec_public": (EC_PUBLIC, "key"), "ed25519": (ED25519, "key"), "rsa": (RSA, "key"), "ssh": (SSH, "ssh"), "ssh_rsa": (SSH_RSA, "ssh"), "openssh": (OPENSSH, "ssh")}


def lines(text, end="\n"):
    return end.join(text[i : i + 64] for i in range(0, len(text), 64))


@pytest.mark.parametrize("name", VALUES)
def test_values_are_found_where_they_stand(name):
    data, kind = VALUES[name]
    whole = base64.b64encode(data).decode()
    bare, url = whole.rstrip("="), base64.urlsafe_b64encode(data).decode()
    for value in (whole, bare, url, url.rstrip("="), lines(whole), lines(bare), lines(whole, "\r\n"), lines(whole, "\n    "), lines(whole, "\\n")):
        for before, after in (("", ""), ("PRIVATE_KEY=", "\n"), ("a: ", "\nHello there"), ("-----BEGIN KEY-----\n", "\n-----END KEY-----"), ("x\\n", "\\n-----END"), ('"', '"'), ("", "\nMIIEabcdefghijklmnopqrstuvwxyz")):
            text = before + value + after
            assert secrets.confirmed_spans(text) == [(len(before), len(before) + len(value), kind)], text


def test_what_is_no_key():
    for data in (EC_PRIVATE, ED25519, SSH, OPENSSH):
        good = base64.b64encode(data).decode().rstrip("=")
        for text in (good + "abcd", "x" + good, good[:-6], good[:20] + " " + good[20:], good[:30] + "\n\n" + good[30:]):
            assert not secrets.confirmed_spans(text), text
    for text in ("MAKE" * 30, "MA" + "A" * 60, "AAAAB" + "A" * 5000, "MEUC" + "I" * 90, "b3BlbnNzaC1rZXktdjEA" + "/" * 400):
        assert not secrets.confirmed_spans(text), text


@pytest.mark.parametrize("end", ["\n", "\\n", ""])
def test_length_of_a_key_has_no_limit(end):
    """Also where the length that decides comes behind 200,000 characters."""
    fields = [b"ssh-rsa", bytes(range(256)) * 640, b"\0" + bytes(range(7, 256))]
    value = base64.b64encode(wire(*fields)).decode()
    assert len(value) > 200_000
    text = "key: " + (lines(value, end) if end else value)
    assert secrets.confirmed_spans(text + "\n--") == [(5, len(text), "ssh")]
    assert not secrets.confirmed_spans(text[:-400] + "\n--")


def test_many_public_keys_in_a_private_one():
    data = b"openssh-key-v1\0" + wire(b"none", b"none", b"") + struct.pack(">I", 100) + wire(*[SSH] * 100, bytes(136))
    value = lines(base64.b64encode(data).decode())
    assert secrets.confirmed_spans(f"a\n{value}\nb") == [(2, 2 + len(value), "ssh")]


def test_nested_values_at_any_depth():
    data = der(0x02, b"\x01")
    for _ in range(3000):
        n = len(data)
        data = bytes([0x30]) + (bytes([n]) if n < 128 else b"\x82" + n.to_bytes(2, "big") if n > 255 else b"\x81" + bytes([n])) + data
    assert secrets.der_fills(data, 0, len(data)) == 3001
    assert not secrets.der_fills(data[:-1], 0, len(data) - 1)
