"""Messages with long tags and with multiparts in multiparts."""

import pytest

from florilege.llm import mail

OWN = "The field kept the seed. We saw the old map on the shelf by the door, and then she read the row."


def test_a_long_tag_is_not_text():
    image = '<img src="data:image/png;base64,' + "QUJD " * 5000 + '">'
    message = f"From: a\nContent-Type: text/html\n\n<html><body><p>{OWN}</p>\n<p>{image}</p></body></html>\n"
    assert " ".join(mail.own_text(message)).split() == OWN.split()


@pytest.mark.parametrize("depth", [1, 5, 6, 40, 1000])
def test_multiparts_at_any_depth(depth):
    part = f"Content-Type: text/html\n\n<p>no</p>\n--b0\nContent-Type: text/plain\nContent-Disposition: attachment\n\nattached words\n--b0\nContent-Type: text/plain\n\n{OWN}\n"
    for k in range(depth):
        part = f"Content-Type: multipart/mixed; boundary=b{k}x\n\n--b{k}x\n{part}\n--b{k}x--\n" if k else f"Content-Type: multipart/mixed; boundary=b0\n\n--b0\n{part}--b0--\n"
    assert " ".join(mail.own_text("From: a\n" + part)).split() == OWN.split()
