"""Session, configuration and the views the queries run on."""
