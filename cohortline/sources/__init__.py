"""Reading, recognising, writing and reporting on tables."""
