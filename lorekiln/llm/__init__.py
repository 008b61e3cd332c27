"""Training-data operators.  ``QUERIES`` and ``ORACLES`` hold this subpackage's driver entries."""
