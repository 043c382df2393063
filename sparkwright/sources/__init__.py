"""Tables with declared schemas, other formats, sinks, and the shared folder."""
