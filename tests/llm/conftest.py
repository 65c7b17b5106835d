import pytest

from castline.session import ship_package


@pytest.fixture(autouse=True)
def shipped(spark):
    ship_package(spark)
