"""Analytics over the session logs and tool-event journals of coding agents, as Spark DataFrame jobs."""
