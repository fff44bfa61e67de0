"""Column builders: text normalisation, dates, field extraction, similarity."""
