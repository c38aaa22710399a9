import pytest

from roadloom.functions import names


def test_ids():
    for i in (0, 1, -1, -10, 35184372088823, -(2**62)):
        assert names.decode_id(names.encode_id(i)) == i


def test_names():
    assert names.direction("forward").flipped() is names.Direction.BACKWARD
    for wrong in (names.profile, names.algorithm, names.direction):
        with pytest.raises(ValueError, match="."):
            wrong("teleport")


def test_seventeen_profiles():
    assert len(names.PROFILES) + len(names.TWO_PART) + len(names.SHARED) == 17
