"""Expression builders on columns; nothing here leaves the JVM."""
