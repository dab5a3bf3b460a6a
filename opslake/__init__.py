"""opslake: analytics over the metadata of scheduled jobs and inbound data feeds, on Spark."""
