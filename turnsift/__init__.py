"""turnsift: searching, ranking, redacting and auditing turn-structured text on Spark."""
