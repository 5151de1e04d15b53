"""No stream operators: the analyses are batch jobs over finished samples."""
