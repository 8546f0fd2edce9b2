"""Named queries over the shared tables, each with its SQL twin where SQL can say it."""
