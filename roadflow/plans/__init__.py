"""Multi-operator jobs: whole-run simulation, aggregation, reports, demand."""
