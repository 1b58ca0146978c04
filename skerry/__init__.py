"""A PySpark analytics engine: statistics, sequences, diversity, graphs, simulation, validation and text guards."""
