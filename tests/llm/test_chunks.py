"""Messages from chunks to buckets stay worth their overhead as the input grows."""

import pytest

from kartoteka.llm import chunks


def message_bytes(size):
    """Key bytes of a message: a chunk's words of about six bytes, eight bytes each, dealt over the buckets."""
    chunk, bucket = chunks.sizes_for(size)
    return chunk / 6 * 8 / max(1, size / bucket)


@pytest.mark.parametrize("size", [1e9, 3e10, 1e12, 7e12])
def test_a_kilobyte_up_to_some_terabytes(size):
    assert message_bytes(size) >= 1000


def test_several_keys_at_100_terabytes():
    assert message_bytes(1e14) >= 5 * 8
    assert chunks.sizes_for(1e14) == (64_000_000, 96_000_000)
    assert chunks.sizes_for(0) == (chunks.CHUNK_BYTES, chunks.BUCKET_BYTES)
