"""The registered queries over the event tables, with their SQL counterparts."""
