import pytest


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from ohlcraft.llm.common import ship

    ship(spark)
