"""Memory of the driver's JVM."""


def test_the_driver_gives_memory_back(spark):
    """What its JVM has freed outside of the heap goes back to the system."""
    from recordloom.llm.common import trim_driver

    assert "rim" in trim_driver(spark)
