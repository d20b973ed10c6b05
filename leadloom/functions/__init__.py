"""Column -> Column functions; they stay inside the JVM unless a module says otherwise."""
