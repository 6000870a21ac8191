import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from ticketflow.session import local_session

    folder = str(tmp_path_factory.mktemp("shared"))
    return local_session(8, "ticketflow-tests", spark__checkpoint__dir=folder)


@pytest.fixture(scope="session")
def tickets(spark, tmp_path_factory):
    """The standard table, written once."""
    from ticketflow.operators.synth import synthesize_tickets

    path = str(tmp_path_factory.mktemp("tickets") / "t")
    synthesize_tickets(spark).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def splits(tickets, tmp_path_factory):
    from ticketflow.plans.training import store_splits

    return store_splits(tickets.drop("pos"), str(tmp_path_factory.mktemp("splits") / "s"))
