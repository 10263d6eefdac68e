import pytest

from rarespark.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        8, "tests", spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")), spark__driver__memory="6g"
    )
    yield session
    session.stop()
