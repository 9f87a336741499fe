"""Schedule cleansing on Spark: discover, map, check, review and clean property schedules."""
