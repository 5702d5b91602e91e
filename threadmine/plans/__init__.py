"""Plans: operators put together to the jobs a user runs."""
