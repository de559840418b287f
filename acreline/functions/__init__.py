"""acreline.functions"""
