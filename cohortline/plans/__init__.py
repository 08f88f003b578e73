"""The jobs: operators composed from raw tables to results."""
