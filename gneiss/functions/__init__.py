"""gneiss.functions"""
