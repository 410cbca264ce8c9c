"""The shared folder where the session names one, and where it does not."""

from types import SimpleNamespace

import pytest

from stratalens.llm import common


def session(master, folder=None, app="app"):
    """What ``shared_dir`` looks at of a session; settings cannot be changed."""
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: folder or default), sparkContext=SimpleNamespace(master=master, applicationId=app))


def test_shared_folder():
    assert common.shared_dir(session("spark://host:7077", "hdfs:///shared")) == "hdfs:///shared"
    made = common.shared_dir(session("local[2]", app="one"))
    assert made.startswith("file:///") and made == common.shared_dir(session("local[2]", app="one"))
    assert made != common.shared_dir(session("local[2]", app="two"))
    with pytest.raises(ValueError):
        common.shared_dir(session("spark://host:7077"))
