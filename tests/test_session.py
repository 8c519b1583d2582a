from types import SimpleNamespace

import pytest

from stallwise.session import shared_folder


def session(master, folder=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda path: None)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: folder))


@pytest.mark.parametrize("master", ["local-cluster[2,1,512]", "spark://host:7077", "yarn"])
def test_executors_need_a_shared_folder(master):
    with pytest.raises(RuntimeError):
        shared_folder(session(master))
    assert shared_folder(session(master, "/shared")) == "/shared"
    assert shared_folder(session("local[2]")) and shared_folder(session("local"))
